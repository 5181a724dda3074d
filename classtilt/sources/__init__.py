from classtilt.sources.readers import (
    src_catalog,
    src_dataset,
    src_digest,
    src_hash_table,
    src_manifest,
    src_overrides,
    src_provenance,
)
from classtilt.sources.writers import snk_manifest, snk_partitioned, snk_table, snk_union

__all__ = [
    "snk_manifest",
    "snk_partitioned",
    "snk_table",
    "snk_union",
    "src_catalog",
    "src_dataset",
    "src_digest",
    "src_hash_table",
    "src_manifest",
    "src_overrides",
    "src_provenance",
]
