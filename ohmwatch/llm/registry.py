"""The queries of the operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from ohmwatch.llm.chat import op10_chat
from ohmwatch.llm.context_tree import op8_context_tree
from ohmwatch.llm.decontaminate import op3_decontaminate
from ohmwatch.llm.exact import OP5_SQL, op5_exact_dedup
from ohmwatch.llm.jaccard import op13_ngram_jaccard
from ohmwatch.llm.licences import OP6_SQL, op6_licences
from ohmwatch.llm.mixing import op1_mixing
from ohmwatch.llm.quality import op4_quality
from ohmwatch.llm.ranked import OP12_SQL, op12_ranked_search
from ohmwatch.llm.repair import OP11_SQL, op11_repair
from ohmwatch.llm.simhash import op7_simhash
from ohmwatch.llm.toxicity import op2_toxicity
from ohmwatch.llm.urls import OP9_SQL, op9_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_toxicity, op3_decontaminate, op4_quality, op5_exact_dedup,
        op6_licences, op7_simhash, op8_context_tree, op9_url_filter, op10_chat,
        op11_repair, op12_ranked_search, op13_ngram_jaccard,
    )
}
ORACLE = {"op5_exact_dedup": OP5_SQL, "op6_licences": OP6_SQL, "op9_url_filter": OP9_SQL, "op11_repair": OP11_SQL, "op12_ranked_search": OP12_SQL}
