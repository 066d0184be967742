"""Registered training-data queries and their oracles."""

from lattica.llm import license, repair, spelling
from lattica.llm.html_text import op5_html_text
from lattica.llm.license import op10_license
from lattica.llm.lm import op8_lm_score
from lattica.llm.media import op7_media_chunks
from lattica.llm.mixing import op9_mixing
from lattica.llm.packing import op4_packing
from lattica.llm.pii import op1_pii
from lattica.llm.quality import op2_quality
from lattica.llm.repair import op12_repair
from lattica.llm.sharding import op11_sharding
from lattica.llm.simhash import op6_simhash
from lattica.llm.spelling import op13_spelling
from lattica.llm.token_files import op3_token_files

QUERIES = {"op1_pii": op1_pii, "op2_quality": op2_quality, "op3_token_files": op3_token_files, "op4_packing": op4_packing, "op5_html_text": op5_html_text, "op6_simhash": op6_simhash, "op7_media_chunks": op7_media_chunks, "op8_lm_score": op8_lm_score, "op9_mixing": op9_mixing, "op10_license": op10_license, "op11_sharding": op11_sharding, "op12_repair": op12_repair, "op13_spelling": op13_spelling}
ORACLE: dict[str, str] = {"op10_license": license.oracle(), "op12_repair": repair.oracle(), "op13_spelling": spelling.oracle()}
