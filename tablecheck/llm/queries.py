"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from tablecheck.llm.decontaminate import OP5_SQL, op5_decontaminate
from tablecheck.llm.language import op2_language
from tablecheck.llm.line_dedup import OP1_SQL, op1_line_dedup
from tablecheck.llm.mixing import op8_mixing
from tablecheck.llm.ngram_join import OP13_SQL, op13_ngram_join
from tablecheck.llm.periodic_runs import OP11_SQL, op11_periodic_runs
from tablecheck.llm.perplexity import op9_perplexity
from tablecheck.llm.pii import op4_pii
from tablecheck.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from tablecheck.llm.quality_rules import op10_quality_rules
from tablecheck.llm.simhash import op3_simhash
from tablecheck.llm.token_files import op6_token_files
from tablecheck.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_language,
        op3_simhash,
        op4_pii,
        op5_decontaminate,
        op6_token_files,
        op7_toxicity,
        op8_mixing,
        op9_perplexity,
        op10_quality_rules,
        op11_periodic_runs,
        op12_prefix_trie,
        op13_ngram_join,
    )
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op5_decontaminate": OP5_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_ngram_join": OP13_SQL,
}
