"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from driftlake.llm import conversation_repair, hard_negatives, substring_dedup, topk_search
from driftlake.llm.byte_bpe import op4_byte_bpe
from driftlake.llm.conversation_repair import op13_conversation_repair
from driftlake.llm.hard_negatives import op11_hard_negatives
from driftlake.llm.jpeg_media import op8_jpeg_media
from driftlake.llm.license_scan import op5_license_scan
from driftlake.llm.packing import op10_packing
from driftlake.llm.quality import op12_attention_quality
from driftlake.llm.secret_scan import op3_secret_scan
from driftlake.llm.simhash import op7_simhash
from driftlake.llm.substring_dedup import op1_substring_dedup
from driftlake.llm.topk_search import op9_topk_search
from driftlake.llm.toxicity import op6_toxicity
from driftlake.llm.warc import op2_warc

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_secret_scan, op4_byte_bpe, op5_license_scan, op6_toxicity, op7_simhash, op8_jpeg_media, op9_topk_search, op10_packing, op11_hard_negatives, op12_attention_quality, op13_conversation_repair)}
ORACLE_SQL = {"op1_substring_dedup": substring_dedup.ORACLE_SQL, "op9_topk_search": topk_search.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op13_conversation_repair": conversation_repair.ORACLE_SQL}
