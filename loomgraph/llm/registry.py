"""The subpackage's queries and their oracle SQL, by name."""

from __future__ import annotations

from loomgraph.llm.chunk_dedup import op9_chunk_dedup
from loomgraph.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from loomgraph.llm.licenses import op5_license_scan
from loomgraph.llm.lm_score import op2_lm_score
from loomgraph.llm.media import op8_audio_features
from loomgraph.llm.mixing import OP6_SQL, op6_mixing_sources
from loomgraph.llm.near_dup import op4_near_duplicates
from loomgraph.llm.packing import op7_best_fit_packing
from loomgraph.llm.quality import op1_quality
from loomgraph.llm.suffix_dedup import op3_suffix_array_dedup

QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_lm_score, op3_suffix_array_dedup, op4_near_duplicates, op5_license_scan, op6_mixing_sources, op7_best_fit_packing, op8_audio_features, op9_chunk_dedup, op10_exact_dedup)
}
ORACLES = {"op6_mixing_sources": OP6_SQL, "op10_exact_dedup": OP10_SQL}
