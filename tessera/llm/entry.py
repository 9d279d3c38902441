"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, codes, fingerprints, language, licenses, media, neardup, packing, pii, runs, urls, wrappers

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_pack_genetic": packing.op2_pack_genetic,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_url_filter": urls.op4_url_filter,
    "op5_language_codes": language.op5_language_codes,
    "op6_minhash_bayes": neardup.op6_minhash_bayes,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
    "op7_bpe_transducer": bpe.op7_bpe_transducer,
    "op8_chat_format": chat.op8_chat_format,
    "op9_media_jpeg": media.op9_media_jpeg,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_html_wrappers": wrappers.op12_html_wrappers,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
SQL = {"op3_license_scan": licenses.OP3_SQL, "op4_url_filter": urls.OP4_SQL, "op6_minhash_bayes": neardup.OP6_SQL, "op8_chat_format": chat.OP8_SQL, "op11_vector_codes": codes.OP11_SQL}
