"""Queries of the text operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup
from .exact_dedup import op8_exact_dedup
from .fingerprints import op10_fingerprints
from .hmm import op2_hmm
from .language import op7_language_id
from .line_dedup import op1_line_dedup
from .mixing import op6_mixing
from .packing import op5_packing
from .quality import op4_quality
from .repeats import op3_repeats
from .simhash import op9_simhash

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_hmm, op3_repeats, op4_quality, op5_packing, op6_mixing, op7_language_id, op8_exact_dedup, op9_simhash, op10_fingerprints)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {"op8_exact_dedup": exact_dedup.OP8_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
