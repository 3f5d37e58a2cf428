"""All queries of the subpackage; importing this module registers them."""

from . import op1_minhash, op2_tokens, op3_neighbours, op4_language, op5_secrets  # noqa: F401
from . import op6_packing, op7_warc, op8_mixing, op9_shards, op10_rules  # noqa: F401
from . import op11_divergence, op12_substrings, op13_interactions  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
