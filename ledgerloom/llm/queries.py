"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from .codebooks import OP11_SQL, op11_vector_codes
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .hamming import OP10_SQL, op10_hamming_topk
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .license_scan import OP9_SQL, op9_license_scan
from .ngram_join import op7_ngram_jaccard_join
from .packing import op6_best_fit_packing
from .piece_scan import op4_sentencepiece_scan
from .pii import op2_pii_crf
from .quality import op5_quality_classifier
from .substrings import OP13_SQL, op13_substring_dedup
from .toxicity import op8_toxicity
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_pii_crf, op3_url_filter, op4_sentencepiece_scan, op5_quality_classifier, op6_best_fit_packing, op7_ngram_jaccard_join, op8_toxicity, op9_license_scan, op10_hamming_topk, op11_vector_codes, op12_hard_negatives, op13_substring_dedup)}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op3_url_filter": OP3_SQL, "op9_license_scan": OP9_SQL, "op10_hamming_topk": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_substring_dedup": OP13_SQL}
