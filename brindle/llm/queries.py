"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .embedding_passes import op6_embedding_passes
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .host_suffix import op1_host_suffix
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality_lsa import op5_quality_knn
from .sentencepiece_fst import op9_sentencepiece
from .secret_ledger import OP12_SQL, op12_secret_ledger
from .simhash_golay import op10_simhash_dedup
from .source_mix import op4_source_mix
from .token_frames import op7_token_frames
from .toxicity_fm import op3_toxicity
from .warc_bundles import OP2_SQL, op2_warc_bundles

QUERIES = {
    f.__name__: f
    for f in (op1_host_suffix, op2_warc_bundles, op3_toxicity, op4_source_mix, op5_quality_knn, op6_embedding_passes, op7_token_frames, op8_exact_dedup, op9_sentencepiece, op10_simhash_dedup, op11_hard_negatives, op12_secret_ledger, op13_prefix_trie)
}

ORACLES = {"op2_warc_bundles": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_secret_ledger": OP12_SQL, "op13_prefix_trie": OP13_SQL}
