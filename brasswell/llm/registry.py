"""The queries of this folder and their SQL."""

from __future__ import annotations

from brasswell.llm.fmindex import op6_decontamination
from brasswell.llm.hardneg import OP13_SQL, op13_hard_negatives
from brasswell.llm.jpeg import op10_media
from brasswell.llm.linededup import OP3_SQL, op3_line_dedup
from brasswell.llm.lmscore import op1_lm_score
from brasswell.llm.neardup import op7_near_dedup
from brasswell.llm.packing import op4_packing
from brasswell.llm.quality import op9_quality
from brasswell.llm.repair import OP11_SQL, op11_conversation_repair
from brasswell.llm.secrets import op5_secret_scan
from brasswell.llm.suffixdedup import OP12_SQL, op12_suffix_dedup
from brasswell.llm.tokens import op8_token_counts
from brasswell.llm.urlfilter import OP2_SQL, op2_url_filter

QUERIES = {f.__name__: f for f in (op1_lm_score, op2_url_filter, op3_line_dedup, op4_packing, op5_secret_scan, op6_decontamination, op7_near_dedup, op8_token_counts, op9_quality, op10_media, op11_conversation_repair, op12_suffix_dedup, op13_hard_negatives)}

ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op3_line_dedup": OP3_SQL, "op11_conversation_repair": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
