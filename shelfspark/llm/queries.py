"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bitmap_bpe import op10_bitmap_bpe
from .collision_projections import op9_collision_projections
from .dimension_merge import SQL as DIMENSION_SQL
from .dimension_merge import op13_dimension_merge
from .ecoc_lang import op5_ecoc_lang
from .kd_shards import op2_kd_shards
from .knn_toxicity import op6_knn_toxicity
from .line_dedup import op3_line_dedup
from .merkle_manifest import SQL as MERKLE_SQL
from .merkle_manifest import op12_merkle_manifest
from .scaled_sketch import op11_scaled_sketch
from .simhash_bk import op4_simhash_bk
from .suffix_dedup import op7_suffix_dedup
from .vector_packing import op8_vector_packing
from .webp_lossless import op1_webp_lossless


_ALL = (
    op1_webp_lossless, op2_kd_shards, op3_line_dedup, op4_simhash_bk, op5_ecoc_lang, op6_knn_toxicity, op7_suffix_dedup, op8_vector_packing, op9_collision_projections, op10_bitmap_bpe,
    op11_scaled_sketch, op12_merkle_manifest, op13_dimension_merge,
)


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    return {"op12_merkle_manifest": MERKLE_SQL, "op13_dimension_merge": DIMENSION_SQL}
