"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from wadi.llm.chat import OP7_SQL, op7_chat
from wadi.llm.chat_log import CHAT_LOG_SQL, chat_log
from wadi.llm.chosen_path import OP2_SQL, op2_near_dedup
from wadi.llm.decontaminate import op1_decontaminate
from wadi.llm.fill_middle import OP11_SQL, op11_fill_middle
from wadi.llm.licenses import OP3_SQL, op3_licenses
from wadi.llm.packing import op8_packing
from wadi.llm.simhash import op12_simhash
from wadi.llm.spelling import op13_spelling
from wadi.llm.suffix_tree import op10_suffix_tree
from wadi.llm.tag_paths import op6_tag_paths
from wadi.llm.toxicity import op5_toxicity
from wadi.llm.warc import OP9_SQL, op9_warc
from wadi.llm.winnowing import op4_winnowing

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_dedup": op2_near_dedup,
    "op3_licenses": op3_licenses,
    "op4_winnowing": op4_winnowing,
    "op5_toxicity": op5_toxicity,
    "op6_tag_paths": op6_tag_paths,
    "op7_chat": op7_chat,
    "chat_log": chat_log,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_fill_middle": op11_fill_middle,
    "op12_simhash": op12_simhash,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op2_near_dedup": OP2_SQL,
    "op3_licenses": OP3_SQL,
    "op7_chat": OP7_SQL,
    "chat_log": CHAT_LOG_SQL,
    "op9_warc": OP9_SQL,
    "op11_fill_middle": OP11_SQL,
}
