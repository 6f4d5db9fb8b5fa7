"""The queries of this folder's operators, and SQL for those that have a form in it."""

from __future__ import annotations

from lapwing.llm import collocations, fixity, html, jpeg, licenses, mixing, packing, preferences, quality, repair, simhash, toxicity, vectors

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_fixity": fixity.op2_fixity,
    "op3_near_vectors": vectors.op3_near_vectors,
    "op4_packing": packing.op4_packing,
    "op5_mixing": mixing.op5_mixing,
    "op6_jpeg": jpeg.op6_jpeg,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_html": html.op8_html,
    "op9_simhash": simhash.op9_simhash,
    "op10_preferences": preferences.op10_preferences,
    "op11_repair": repair.op11_repair,
    "op12_collocations": collocations.op12_collocations,
    "op13_quality": quality.op13_quality,
}
ORACLES = {"op2_fixity": fixity.ORACLE, "op10_preferences": preferences.ORACLE, "op11_repair": repair.ORACLE, "op12_collocations": collocations.ORACLE}
