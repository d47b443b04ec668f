"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from tracefold.llm.bpe import op9_byte_bpe
from tracefold.llm.chunks import op1_media_chunks
from tracefold.llm.linededup import OP3_SQL, op3_line_dedup
from tracefold.llm.mixing import OP4_SQL, op4_mix_sources
from tracefold.llm.ngramjoin import op7_ngram_jaccard
from tracefold.llm.pii import op8_personal_data
from tracefold.llm.quality import OP10_SQL, op10_quality_rules
from tracefold.llm.rollup import op6_token_rollup
from tracefold.llm.secrets import OP5_SQL, op5_secret_scan
from tracefold.llm.warc import OP2_SQL, op2_warc_normalise

QUERIES = {
    "op1_media_chunks": op1_media_chunks,
    "op2_warc_normalise": op2_warc_normalise,
    "op3_line_dedup": op3_line_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_rollup": op6_token_rollup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_personal_data": op8_personal_data,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES = {
    "op2_warc_normalise": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_mix_sources": OP4_SQL,
    "op5_secret_scan": OP5_SQL,
    "op10_quality_rules": OP10_SQL,
}
