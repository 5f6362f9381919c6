"""The corpus queries and their SQL, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticeloom.llm.bpe import op4_bpe
from noticeloom.llm.chat import OP7_SQL, op7_chat_formatting
from noticeloom.llm.fingerprints import op5_fingerprints
from noticeloom.llm.mixing import OP10_SQL, op10_mixing
from noticeloom.llm.nearest import op3_nearest
from noticeloom.llm.neardup import op8_minhash_near_dedup
from noticeloom.llm.prefixtrie import op11_prefix_trie
from noticeloom.llm.runs import op12_periodic_runs
from noticeloom.llm.secretscan import op13_secret_scan
from noticeloom.llm.surrogates import op2_pii_surrogates
from noticeloom.llm.tokenlengths import op6_token_counts
from noticeloom.llm.toxicity import op1_toxicity
from noticeloom.llm.urlfilter import OP9_SQL, op9_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pii_surrogates": op2_pii_surrogates,
        "op3_nearest": op3_nearest,
        "op4_bpe": op4_bpe,
        "op5_fingerprints": op5_fingerprints,
        "op6_token_counts": op6_token_counts,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_url_filters": op9_url_filters,
        "op10_mixing": op10_mixing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_secret_scan": op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_formatting": OP7_SQL, "op9_url_filters": OP9_SQL, "op10_mixing": OP10_SQL}
