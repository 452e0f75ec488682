"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bestfit import op12_bestfit
from .chat import ORACLE as CHAT_SQL
from .chat import op6_chat
from .fingerprints import op4_fingerprints
from .langid import op1_langid
from .merkle import op11_merkle, oracle as merkle_sql
from .mixing import op9_mixing, oracle as mixing_sql
from .packing import op2_packing
from .quality_model import op7_quality
from .quality_rules import op10_quality_rules
from .secrets import op3_secrets
from .simhash import op5_simhash
from .toxicity import op8_toxicity
from .trie import ORACLE as TRIE_SQL
from .trie import op13_trie

QUERIES = {
    "op1_langid": op1_langid,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle": op11_merkle,
    "op12_bestfit": op12_bestfit,
    "op13_trie": op13_trie,
}
ORACLE_SQL: dict[str, str] = {"op6_chat": CHAT_SQL, "op9_mixing": mixing_sql(), "op11_merkle": merkle_sql(), "op13_trie": TRIE_SQL}
