"""Queries of this subpackage and their SQL."""

from . import bpe, first_fit, hnsw, merkle, mixing, packing, quartile_digest, secrets, simhash, spelling, token_counts, toxicity, warc

QUERIES = {
    "op1_hnsw": hnsw.query,
    "op2_toxicity": toxicity.query,
    "op3_packing": packing.query,
    "op4_token_counts": token_counts.query,
    "op5_secrets": secrets.query,
    "op6_mixing": mixing.query,
    "op7_bpe": bpe.query,
    "op8_fingerprints": quartile_digest.query,
    "op9_simhash": simhash.query,
    "op10_warc": warc.query,
    "op11_spelling": spelling.query,
    "op12_first_fit": first_fit.query,
    "op13_merkle": merkle.query,
}
ORACLES: dict[str, str] = {
    "op1_hnsw": hnsw.ORACLE,
    "op6_mixing": mixing.oracle(),
    "op10_warc": warc.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
