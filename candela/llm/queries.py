"""All queries of the subpackage; importing the operator modules registers them."""

from candela.llm import (  # noqa: F401
    bpe, chat, fim, jaccard_join, language, lm_score, mixing, packing, quality, runs, simhash, toxicity, url_filter,
)
from candela.llm.registry import QUERIES, SQL  # noqa: F401
