"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import op1_substring_dedup as op1
from . import op2_suffix_array_dedup as op2
from . import op3_media_png as op3
from . import op4_order_minhash as op4
from . import op5_source_mixing as op5
from . import op6_token_counts as op6
from . import op7_sentencepiece_sampling as op7
from . import op8_language_id as op8
from . import op9_quality_classifier as op9
from . import op10_minhash_near_dedup as op10
from . import op11_byte_bpe as op11
from . import op12_embedding_whitening as op12
from . import op13_ranked_search as op13

QUERIES = {
    "op1_substring_dedup": op1.op1_substring_dedup,
    "op2_suffix_array_dedup": op2.op2_suffix_array_dedup,
    "op3_media_png": op3.op3_media_png,
    "op4_order_minhash": op4.op4_order_minhash,
    "op5_source_mixing": op5.op5_source_mixing,
    "op6_token_counts": op6.op6_token_counts,
    "op7_sentencepiece_sampling": op7.op7_sentencepiece_sampling,
    "op8_language_id": op8.op8_language_id,
    "op9_quality_classifier": op9.op9_quality_classifier,
    "op10_minhash_near_dedup": op10.op10_minhash_near_dedup,
    "op11_byte_bpe": op11.op11_byte_bpe,
    "op12_embedding_whitening": op12.op12_embedding_whitening,
    "op13_ranked_search": op13.op13_ranked_search,
}
ORACLES = {
    "op10_minhash_near_dedup": op10.SQL,
    "op13_ranked_search": op13.SQL,
}
