"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from . import automaton, bpe, chat, embeddings, media, merkle, packing, polytope, secrets, simhash, suffix_array, toxicity, whitening
from .oracles import ORACLE_SQL as ORACLE_SQL

QUERIES = {
    "op1_secret_novelty": secrets.query,
    "op2_subspace_embeddings": embeddings.query,
    "op3_best_fit_packing": packing.query,
    "op4_suffix_array_dedup": suffix_array.query,
    "op5_golay_simhash": simhash.query,
    "op6_prefix_tree_chat": chat.query,
    "op7_byte_bpe": bpe.query,
    "op8_noisy_channel_toxicity": toxicity.query,
    "op9_progressive_jpeg": media.query,
    "op10_suffix_automaton_dedup": automaton.query,
    "op11_cross_polytope": polytope.query,
    "op12_merkle_manifest": merkle.query,
    "op13_chebyshev_whitening": whitening.query,
}
