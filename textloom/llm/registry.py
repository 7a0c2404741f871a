"""The corpus operators' queries, and the SQL of those that SQL can express."""

from . import decontam, infill, linededup
from .alignment import op12_event_sweep
from .anchor_dedup import op9_difference_cover
from .bpe import op13_prefix_bpe
from .decontam import op6_winnowing
from .fingerprint import op3_quartile_digest
from .infill import op11_infill_index
from .langid import op7_word_first_backoff
from .linededup import op8_distinct_site_spread
from .mixing import op1_multinomial_blocks
from .neardup import op10_bottom_k
from .pii import op4_weak_supervision
from .quality import op5_quadratic_discriminant
from .suffix_dedup import op2_column_wise_suffixes

QUERIES = {
    f.__name__: f
    for f in (
        op1_multinomial_blocks, op2_column_wise_suffixes, op3_quartile_digest, op4_weak_supervision, op5_quadratic_discriminant, op6_winnowing,
        op7_word_first_backoff, op8_distinct_site_spread, op9_difference_cover, op10_bottom_k, op11_infill_index, op12_event_sweep,
        op13_prefix_bpe,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_winnowing": decontam.SQL, "op8_distinct_site_spread": linededup.SQL, "op11_infill_index": infill.SQL}
