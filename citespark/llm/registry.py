"""All queries of the subpackage and their SQL."""

from citespark.llm import (  # noqa: F401
    counts, decontamination, factorisation, html, jaccard, language, packing, pii, quality, ranked, repair, secrets, toolcalls,
)
from citespark.llm.common import ORACLES, QUERIES  # noqa: F401
