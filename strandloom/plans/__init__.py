"""Plans: pipelines of codecs, choices by data, searches for better ones."""
