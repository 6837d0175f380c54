"""The registered queries of this subpackage, and the SQL that must give the same rows."""

from textpulse.llm import chunk_bpe, decontamination, exact_dedup, hard_negatives, language_id, main_text, merkle, near_dedup, piece_bpe, repeats, sharding, token_files, url_reputation
from textpulse.llm.common import ORACLES, QUERIES  # noqa: F401
