"""The queries of this package, for the entry file, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, minhash_dedup
from .alignment import op12_tokenizer_alignment
from .collocations import op13_phrase_collocations
from .decontaminate import op9_decontamination
from .language_id import op2_language_id
from .license_scan import op3_license_scan
from .line_dedup import op1_line_dedup
from .minhash_dedup import op11_hyperminhash_dedup
from .mixing import op8_source_mixing
from .pii import op7_pii_pseudonyms
from .quality_rules import op4_quality_rules
from .simhash_dedup import op10_simhash_dedup
from .token_counts import op6_token_counts
from .token_output import op5_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_license_scan, op4_quality_rules, op5_token_output, op6_token_counts, op7_pii_pseudonyms, op8_source_mixing, op9_decontamination, op10_simhash_dedup, op11_hyperminhash_dedup, op12_tokenizer_alignment, op13_phrase_collocations)}

ORACLE: dict[str, str] = {"op11_hyperminhash_dedup": minhash_dedup.SQL, "op13_phrase_collocations": collocations.SQL}
