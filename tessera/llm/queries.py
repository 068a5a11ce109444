"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import codes, decontamination, embeddings, licenses, manifest, mixing, pii, secrets, simhash, substrings, suffixes, toxicity, urlfilter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_pii": pii.op4_pii,
    "op5_suffix_array": suffixes.op5_suffix_array,
    "op6_substrings": substrings.op6_substrings,
    "op7_simhash": simhash.op7_simhash,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_secrets": secrets.op10_secrets,
    "op11_licenses": licenses.op11_licenses,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_manifest": manifest.op13_manifest,
}

ORACLE_SQL = {
    "op3_embeddings": embeddings.SQL,
    "op6_substrings": substrings.SQL,
    "op8_mixing": mixing.SQL,
    "op9_url_filter": urlfilter.SQL,
    "op11_licenses": licenses.SQL,
    "op12_vector_codes": codes.SQL,
    "op13_manifest": manifest.SQL,
}
