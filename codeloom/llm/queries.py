"""Queries of the ten corpus operators.  None of them can be said in SQL, so ORACLES is empty."""

from .decontamination import op9_template_leaks
from .ngram_join import op2_ngram_join
from .packing import op8_best_fit_bins
from .quality_classifier import op7_quality_discriminant
from .quality_rules import op1_compression_bands
from .repeats import op6_repeated_passages
from .secret_scan import op5_linked_secrets
from .token_blocks import op10_rans_blocks
from .tokenizer import op4_token_counts
from .toxicity import op3_toxic_windows

QUERIES = {f.__name__: f for f in (op1_compression_bands, op2_ngram_join, op3_toxic_windows, op4_token_counts, op5_linked_secrets, op6_repeated_passages, op7_quality_discriminant, op8_best_fit_bins, op9_template_leaks, op10_rans_blocks)}
ORACLES: dict[str, str] = {}
