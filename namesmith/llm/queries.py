"""The registered queries of this package."""

from __future__ import annotations

import corpus_pipeline
from namesmith.llm import bpe, decontam, divergence, langid, lines, neardup, packing, parsing, private, quality, scoring, tries, urls
from namesmith.plans import Registry

AREA = Registry()
AREA.add("op1_neardup")(neardup.op1_neardup)
AREA.add("op2_language")(langid.op2_language)
AREA.add("op3_packing")(packing.op3_packing)
AREA.add("op4_lines")(lines.op4_lines)
AREA.add("op5_scores")(scoring.op5_scores)
AREA.add("op6_private")(private.op6_private)
AREA.add("op7_fingerprints")(parsing.op7_fingerprints)
AREA.add("op8_bpe")(bpe.op8_bpe)
AREA.add("op9_quality")(quality.op9_quality)
AREA.add("op10_urls", urls.SQL)(urls.op10_urls)
AREA.add("op11_divergence", divergence.SQL)(divergence.op11_divergence)
AREA.add("op12_prefixes", tries.SQL)(tries.op12_prefixes)
AREA.add("op13_decontamination", decontam.SQL)(decontam.op13_decontamination)
AREA.add("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
