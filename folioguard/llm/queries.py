"""The operators' registered queries and, where SQL can express them, their SQL."""

from folioguard.llm.best_fit import op13_best_fit
from folioguard.llm.decontamination import OP8_SQL, op8_decontaminate
from folioguard.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from folioguard.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from folioguard.llm.packing import op3_packing
from folioguard.llm.quality import op5_quality
from folioguard.llm.secrets import op10_secrets
from folioguard.llm.set_join import op2_jaccard_join
from folioguard.llm.snapshot_diff import OP12_SQL, op12_snapshot_diff
from folioguard.llm.suffix_dedup import op1_suffix_dedup
from folioguard.llm.toxicity import op7_toxicity
from folioguard.llm.url_filter import OP4_SQL, op4_url_filter
from folioguard.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_snapshot_diff": op12_snapshot_diff,
    "op13_best_fit": op13_best_fit,
}
ORACLES = {"op4_url_filter": OP4_SQL, "op6_warc": OP6_SQL, "op8_decontaminate": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_snapshot_diff": OP12_SQL}
