"""Imports every module that registers a query of this package."""

from eventfold.llm.base import RUNS, SQL  # noqa: F401
from eventfold.llm import alignment, bytecnn, cotrain, decontam, linededup, packing, perplexity, pii, secrets, simhash, toxicity, warc, whitening  # noqa: F401
