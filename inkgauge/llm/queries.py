"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import code_language, garbled, mixing, packing, prose, provenance, repeats, sentences, spam

QUERIES = {
    "p1_found": prose.p1_found,
    "p1_stats": prose.p1_stats,
    "p2_found": repeats.p2_found,
    "p2_stats": repeats.p2_stats,
    "p3_found": code_language.p3_found,
    "p3_languages": code_language.p3_languages,
    "p4_found": provenance.p4_found,
    "p4_provenance": provenance.p4_provenance,
    "p5_found": sentences.p5_found,
    "p5_sentences": sentences.p5_sentences,
    "p6_found": garbled.p6_found,
    "p6_damage": garbled.p6_damage,
    "p7_packed": packing.p7_packed,
    "p7_containers": packing.p7_containers,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": spam.p9_found,
    "p9_pages": spam.p9_pages,
}
SQL: dict[str, str] = {}
