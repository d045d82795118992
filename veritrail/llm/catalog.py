"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat
from .decontamination import OP1_SQL, op1_decontamination
from .language_model import op2_lm_scoring
from .line_dedup import OP10_SQL, op10_line_dedup
from .media import op3_media
from .near_dedup import OP5_SQL, op5_near_dedup
from .packing import op9_packing
from .sharding import op6_sharding
from .shared import limit_batches
from .toxicity import op7_toxicity
from .warc import OP4_SQL, op4_warc


def _limited(query):
    def run(spark, sf_dir):
        limit_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_decontamination": op1_decontamination,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_media": op3_media,
        "op4_warc": op4_warc,
        "op5_near_dedup": op5_near_dedup,
        "op6_sharding": op6_sharding,
        "op7_toxicity": op7_toxicity,
        "op8_chat": op8_chat,
        "op9_packing": op9_packing,
        "op10_line_dedup": op10_line_dedup,
    }
    return {name: _limited(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op4_warc": OP4_SQL,
        "op5_near_dedup": OP5_SQL,
        "op8_chat": OP8_SQL,
        "op10_line_dedup": OP10_SQL,
    }
