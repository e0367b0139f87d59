"""The registered queries of the operators and, where SQL can state one, its SQL."""

from __future__ import annotations

from epilake.llm.conversations import op12_conversations
from epilake.llm.decontaminate import op7_decontaminate
from epilake.llm.html_text import op9_html_text
from epilake.llm.lang_id import op4_lang_id
from epilake.llm.mixing import OP5_SQL, op5_mix_sources
from epilake.llm.near_dup import op10_minhash
from epilake.llm.negatives import op13_hard_negatives
from epilake.llm.quality import op6_importance_resampling
from epilake.llm.simhash import op2_simhash
from epilake.llm.substrings import op11_substrings
from epilake.llm.tokens import op1_token_orc
from epilake.llm.toxicity import op8_toxicity
from epilake.llm.warc import OP3_SQL, op3_warc_revisits

QUERIES = {q.__name__: q for q in (
    op1_token_orc, op2_simhash, op3_warc_revisits, op4_lang_id, op5_mix_sources, op6_importance_resampling, op7_decontaminate,
    op8_toxicity, op9_html_text, op10_minhash, op11_substrings, op12_conversations, op13_hard_negatives,
)}
ORACLES = {"op3_warc_revisits": OP3_SQL, "op5_mix_sources": OP5_SQL}
