"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from tarnsift.llm import chat, lines, manifest, near_dups, negatives, substrings, topk
from tarnsift.llm.chat import op5_chat
from tarnsift.llm.fingerprints import op6_fingerprints
from tarnsift.llm.languages import op7_languages
from tarnsift.llm.lines import op11_lines
from tarnsift.llm.manifest import op12_manifest
from tarnsift.llm.mixing import op3_mixing
from tarnsift.llm.near_dups import op1_near_dups
from tarnsift.llm.negatives import op13_negatives
from tarnsift.llm.packing import op10_packing
from tarnsift.llm.pages import op9_pages
from tarnsift.llm.substrings import op8_substrings
from tarnsift.llm.topk import op4_topk
from tarnsift.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_near_dups": op1_near_dups,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_topk": op4_topk,
    "op5_chat": op5_chat,
    "op6_fingerprints": op6_fingerprints,
    "op7_languages": op7_languages,
    "op8_substrings": op8_substrings,
    "op9_pages": op9_pages,
    "op10_packing": op10_packing,
    "op11_lines": op11_lines,
    "op12_manifest": op12_manifest,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dups": near_dups.ORACLE_SQL,
    "op4_topk": topk.ORACLE_SQL,
    "op5_chat": chat.ORACLE_SQL,
    "op8_substrings": substrings.ORACLE_SQL,
    "op11_lines": lines.ORACLE_SQL,
    "op12_manifest": manifest.ORACLE_SQL,
    "op13_negatives": negatives.ORACLE_SQL,
}
