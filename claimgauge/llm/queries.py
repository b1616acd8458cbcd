"""The registered query of every operator, and its SQL where SQL can express it."""

import functools

from claimgauge.llm.chat_format import op2_chat_format
from claimgauge.llm.common import ship_package
from claimgauge.llm.context_tree import op11_context_tree
from claimgauge.llm.decontaminate import OP10_SQL, op10_decontaminate
from claimgauge.llm.html_extract import op1_html_extract
from claimgauge.llm.language_id import op8_language_id
from claimgauge.llm.merkle import op13_merkle_manifest
from claimgauge.llm.packing import op4_packing
from claimgauge.llm.prefix_trie import op12_prefix_trie
from claimgauge.llm.quality_rules import OP9_SQL, op9_quality_rules
from claimgauge.llm.simhash_dedup import op3_simhash_dedup
from claimgauge.llm.token_files import op5_token_files
from claimgauge.llm.url_filter import OP6_SQL, op6_url_filter
from claimgauge.llm.warc import OP7_SQL, op7_warc

_OPERATORS = {
    "op1_html_extract": op1_html_extract,
    "op2_chat_format": op2_chat_format,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_packing": op4_packing,
    "op5_token_files": op5_token_files,
    "op6_url_filter": op6_url_filter,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontaminate": op10_decontaminate,
    "op11_context_tree": op11_context_tree,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _shipped(query):
    """The query, after seeing to it that executors can import this package."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in _OPERATORS.items()}
ORACLE = {"op6_url_filter": OP6_SQL, "op7_warc": OP7_SQL, "op9_quality_rules": OP9_SQL, "op10_decontaminate": OP10_SQL}
