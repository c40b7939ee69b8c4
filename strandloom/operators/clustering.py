"""Grouping of streams: which streams are joined and which pipeline each group goes to."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..core import CodecError, Encoded
from .structure import Concat, Interleave


@dataclass
class Cluster:
    tags: list[int]
    kind: str = "long"
    successor: str = "generic"
    codec: str = "concat"


@dataclass
class ClusteringConfig:
    """Clusters by tag, and default successors by type for streams that no cluster names."""

    clusters: list[Cluster] = field(default_factory=list)
    defaults: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        seen: set[tuple[int, str]] = set()
        for c in self.clusters:
            for t in c.tags:
                if (t, c.kind) in seen:
                    raise CodecError(f"tag {t} of type {c.kind} is in two clusters")
                seen.add((t, c.kind))
            if c.codec not in CODECS:
                raise CodecError(f"no clustering codec {c.codec}")
        kinds = [k for k, _ in self.defaults]
        if len(kinds) != len(set(kinds)):
            raise CodecError("two defaults for one type")

    def to_json(self) -> str:
        return json.dumps({"clusters": [vars(c) for c in self.clusters], "defaults": self.defaults})

    @classmethod
    def from_json(cls, text: str) -> ClusteringConfig:
        x = json.loads(text)
        return cls([Cluster(**c) for c in x["clusters"]], [tuple(d) for d in x["defaults"]])


CODECS = {"concat": Concat, "interleave": Interleave}


def cluster(streams: Mapping[int, DataFrame], config: ClusteringConfig, tags: Mapping[int, int] | None = None) -> list[tuple[str, list[int], Encoded]]:
    """(successor, inputs in order, joined stream) of every cluster.

    streams by input number; an input's tag is its number unless `tags` says otherwise.  A configured cluster takes
    the inputs of its tags and type in input order; every other (tag, type) is a cluster of its own.
    """
    kind = {k: s.schema["v"].dataType.typeName() for k, s in streams.items()}
    tag = {k: (tags or {}).get(k, k) for k in streams}
    left, out = sorted(streams), []
    for c in config.clusters:
        members = [k for k in left if tag[k] in c.tags and kind[k] == c.kind]
        if members:
            out.append((c.successor, members, CODECS[c.codec]().encode(*(streams[k] for k in members))))
            left = [k for k in left if k not in members]
    defaults = dict(config.defaults)
    for key in dict.fromkeys((tag[k], kind[k]) for k in left):
        members = [k for k in left if (tag[k], kind[k]) == key]
        out.append((defaults.get(key[1], "generic"), members, Concat().encode(*(streams[k] for k in members))))
    return out


def uncluster(clusters: list[tuple[str, list[int], Encoded]]) -> dict[int, DataFrame]:
    """The inputs by number."""
    out = {}
    for _, members, enc in clusters:
        codec = Concat() if "sizes" in enc.streams else Interleave()
        out.update(zip(members, codec.decode(enc), strict=True))
    return out
