"""The registered queries of the text operators and their SQL, where SQL can express them."""

from quillgraph.llm.bpe import op3_bpe
from quillgraph.llm.divergence import OP11_SQL, op11_divergence
from quillgraph.llm.fingerprints import op12_fingerprints
from quillgraph.llm.html_extract import op1_html_extract
from quillgraph.llm.mixing import op8_mixing
from quillgraph.llm.near_dedup import op10_near_dedup
from quillgraph.llm.neighbours import op7_neighbours
from quillgraph.llm.pii import op4_pii
from quillgraph.llm.quality_model import op2_quality_model
from quillgraph.llm.quality_rules import op6_quality_rules
from quillgraph.llm.resampling import op13_resampling
from quillgraph.llm.token_counts import op5_token_counts
from quillgraph.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_model": op2_quality_model,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_neighbours": op7_neighbours,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
    "op11_divergence": op11_divergence,
    "op12_fingerprints": op12_fingerprints,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {"op11_divergence": OP11_SQL}
