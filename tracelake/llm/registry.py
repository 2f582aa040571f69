"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from tracelake.llm.bpe_codec import op7_bpe_codec
from tracelake.llm.collocations import OP11_SQL, op11_collocations
from tracelake.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tracelake.llm.license_scan import op10_license_scan
from tracelake.llm.line_dedup import OP9_SQL, op9_line_dedup
from tracelake.llm.orc_tokens import op4_orc_tokens
from tracelake.llm.packing import op2_packing
from tracelake.llm.quality import op6_quality
from tracelake.llm.simhash import op5_simhash
from tracelake.llm.spelling import OP13_SQL, op13_spelling
from tracelake.llm.token_counts import op3_token_counts
from tracelake.llm.toxicity import op8_toxicity
from tracelake.llm.url_filters import OP12_SQL, op12_url_filter

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_orc_tokens": op4_orc_tokens,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_url_filter": op12_url_filter,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_url_filter": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
