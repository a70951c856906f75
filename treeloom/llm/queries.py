"""One query for each pipeline operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bit_planes import op4_bit_planes
from .bk_trees import op7_bk_trees
from .co_training import op8_co_training
from .itemset_phrases import op12_itemset_phrases
from .license_scan import op2_license_scan
from .line_runs import op13_line_runs
from .ngram_ratio import op5_ngram_ratio
from .phrase_index import op9_phrase_index
from .piece_counts import op10_piece_counts
from .tag_paths import op3_tag_paths
from .token_alignment import op11_token_alignment
from .two_fit import op6_two_fit
from .warc_fixity import op1_warc_fixity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_warc_fixity": op1_warc_fixity,
        "op2_license_scan": op2_license_scan,
        "op3_tag_paths": op3_tag_paths,
        "op4_bit_planes": op4_bit_planes,
        "op5_ngram_ratio": op5_ngram_ratio,
        "op6_two_fit": op6_two_fit,
        "op7_bk_trees": op7_bk_trees,
        "op8_co_training": op8_co_training,
        "op9_phrase_index": op9_phrase_index,
        "op10_piece_counts": op10_piece_counts,
        "op11_token_alignment": op11_token_alignment,
        "op12_itemset_phrases": op12_itemset_phrases,
        "op13_line_runs": op13_line_runs,
    }
