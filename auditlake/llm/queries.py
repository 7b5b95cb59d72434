"""All queries of this subpackage; importing this module registers them."""

from auditlake.llm import q_conversations, q_dedup, q_fingerprints, q_lang, q_lines, q_pages, q_quality, q_secrets, q_tokens, q_vectors  # noqa: F401
from auditlake.llm.registry import ORACLE, QUERIES  # noqa: F401
