"""What plans must look like: columns pruned at the scan, one exchange by chunk, no Python where built-ins do."""

import re
from pathlib import Path

import pytest

from strandloom import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the sample tables aren't here")

ONE_EXCHANGE = ["delta_encode", "zigzag_encode", "range_pack_encode", "quantize_lengths", "prefix_encode", "histogram", "moments", "merge_sorted_choice", "try_parse_int_numbers", "segment_numeric", "bitpack_size", "parse_int"]
NATIVE = [*ONE_EXCHANGE, "tokenize_first_seen_indices", "merge_sorted_encode", "transpose_split", "dispatch_by_tag", "concat_streams", "feature_vector", "entropy_backend_choice", "brute_force_choice", "boosted_trees_choice", "strides", "stream_profile", "nested_values"]


def plan(spark, name):
    return catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name", ONE_EXCHANGE)
def test_one_exchange(spark, name):
    text = plan(spark, name)
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
    joins = len(re.findall("Join", text))
    assert "SinglePartition" not in text and set(exchanges) <= {"chunk_id"} and len(exchanges) <= 1 + 3 * joins


@pytest.mark.parametrize("name, columns", [("delta_encode", {"o_orderkey", "o_custkey"}), ("histogram", {"l_orderkey", "l_quantity"}), ("prefix_encode", {"c_custkey", "c_name"}), ("asof_join", {"o_orderkey", "o_custkey", "event_id", "user_id", "value"})])
def test_scans_read_only_what_is_asked_for(spark, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)))))
    assert read == columns
