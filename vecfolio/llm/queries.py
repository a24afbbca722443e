"""The training-data queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .bpe import op11_bpe_encoding
from .chat import OP8_SQL, op8_chat_formatting
from .fingerprint import op9_document_fingerprints
from .language import op10_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import op2_mixing
from .neighbours import op7_nearest_neighbours
from .pieces import op4_sentencepiece
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .repair import OP13_SQL, op13_structure_repair
from .simhash import op5_simhash
from .token_files import op3_token_files
from .toxicity import op1_toxicity

QUERIES = {
    q.__name__: q
    for q in (
        op1_toxicity,
        op2_mixing,
        op3_token_files,
        op4_sentencepiece,
        op5_simhash,
        op6_line_dedup,
        op7_nearest_neighbours,
        op8_chat_formatting,
        op9_document_fingerprints,
        op10_language_id,
        op11_bpe_encoding,
        op12_prefix_trie,
        op13_structure_repair,
    )
}

ORACLE_SQL = {"op6_line_dedup": OP6_SQL, "op8_chat_formatting": OP8_SQL, "op12_prefix_trie": OP12_SQL, "op13_structure_repair": OP13_SQL}
