"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from waypoint.llm.align import op13_alignment
from waypoint.llm.centroids import OP11_SQL, op11_centroids
from waypoint.llm.chat import OP9_SQL, op9_chat
from waypoint.llm.classlm import op7_class_lm
from waypoint.llm.fingerprints import op3_fingerprints
from waypoint.llm.htmltext import op1_html_text
from waypoint.llm.langid import op12_language
from waypoint.llm.licences import OP6_SQL, op6_licences
from waypoint.llm.mixing import OP4_SQL, op4_mixing
from waypoint.llm.neighbours import op10_nearest
from waypoint.llm.packing import op2_packing
from waypoint.llm.quality import op5_quality
from waypoint.llm.simhash import op8_simhash_near_dedup

QUERIES = {f.__name__: f for f in (
    op1_html_text,
    op2_packing,
    op3_fingerprints,
    op4_mixing,
    op5_quality,
    op6_licences,
    op7_class_lm,
    op8_simhash_near_dedup,
    op9_chat,
    op10_nearest,
    op11_centroids,
    op12_language,
    op13_alignment,
)}

ORACLE: dict[str, str] = {"op4_mixing": OP4_SQL, "op6_licences": OP6_SQL, "op9_chat": OP9_SQL,
                          "op11_centroids": OP11_SQL}
