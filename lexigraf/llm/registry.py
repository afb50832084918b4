"""Queries of the training-data operators, and SQL where it can express them."""

from .chat import OP6_SQL, op6_chat_format
from .decontaminate import op7_decontaminate
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .jaccard_join import op4_jaccard_join
from .language_id import op10_language_id
from .mixing import OP3_SQL, op3_mixing
from .quality import op9_quality
from .sharding import op1_sharding
from .suffix_dedup import op2_suffix_dedup
from .token_files import op8_token_files

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mixing": op3_mixing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_files": op8_token_files,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
}
SQL = {"op3_mixing": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op6_chat_format": OP6_SQL}
