"""The queries of this subpackage, by name, and SQL where it can express them."""

from __future__ import annotations

from .brown_lm import op9_brown_lm
from .gif_media import op3_gif_media
from .language_nb import op4_language_nb
from .lexical_wand import SQL as WAND_SQL
from .lexical_wand import op11_lexical_wand
from .line_crf import op7_line_crf
from .minhash_odd import SQL as MINHASH_SQL
from .minhash_odd import op12_minhash_odd
from .mix_flow import op2_mix_flow
from .ngram_resample import op13_ngram_resample
from .pack_tiers import op6_pack_tiers
from .pii_semicrf import op8_pii_semicrf
from .quality_fm import op1_quality_fm
from .simhash_cover import op5_simhash_cover
from .token_parquet import op10_token_parquet

QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_mix_flow": op2_mix_flow,
    "op3_gif_media": op3_gif_media,
    "op4_language_nb": op4_language_nb,
    "op5_simhash_cover": op5_simhash_cover,
    "op6_pack_tiers": op6_pack_tiers,
    "op7_line_crf": op7_line_crf,
    "op8_pii_semicrf": op8_pii_semicrf,
    "op9_brown_lm": op9_brown_lm,
    "op10_token_parquet": op10_token_parquet,
    "op11_lexical_wand": op11_lexical_wand,
    "op12_minhash_odd": op12_minhash_odd,
    "op13_ngram_resample": op13_ngram_resample,
}

ORACLE_SQL: dict[str, str] = {"op11_lexical_wand": WAND_SQL, "op12_minhash_odd": MINHASH_SQL}
