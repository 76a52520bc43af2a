"""Token ids of whole texts, for use inside Spark tasks.

The word vocabulary never merges across white space, so the ids of a text are the ids of its white-space separated
chunks, one after the other. Each block of texts is cut into chunks, every distinct chunk is encoded once, and the ids
are put together by array operations. The vocabulary numbers its merges in the order of their rank, so its file can be
read as ranks with a byte of its own for a word's end; ``tests/llm/test_tokens.py`` checks the conditions under which
this equals the tokenizer. Texts with characters about which the libraries could disagree (case, white space, numbers,
normal form, special tokens) take the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

END = "\x01"
# Any of these sends the whole text to the tokenizer; "<|" begins its special tokens.
UNSURE = "[^\\t-\\r -~ -֏‐-‧]|[ΣİẞϴΩ²³¹¼½¾]|<\\|"
# The contractions of the vocabulary's own pattern; then letters, one digit, other signs, end of a chunk.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:[^\\w\\s]|_)+|\n")
# Chunks whose pieces need no search: letters, and at most one of two signs behind them.
PLAIN = "^\\pL+[.,]?$"


def byte_values() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file as bytes and ranks; a word's end is the byte 1 after its last one."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    suffix, special = content["model"]["end_of_word_suffix"], {t["id"] for t in content["added_tokens"]}
    value, ranks = byte_values(), {}
    for word, i in content["model"]["vocab"].items():
        if i not in special:
            last = word.endswith(suffix)
            ranks[bytes(value[c] for c in (word[:-len(suffix)] if last else word)) + b"\x01" * last] = i
    return ranks


def joined(chunks) -> str:
    """The strings of an Arrow array, each with a line end behind it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(chunks):
        return ""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "\n")[0].as_py() + "\n"


class WordEncoder:
    """Ids without special tokens, as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import numpy as np
        import tiktoken

        self.np, self.path, self.slow = np, path, None
        ranks = read_ranks(path)
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        self.mark = ranks[b"\n\x01"]

    def exact(self, text: str):
        """By the tokenizer alone."""
        if self.slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts) -> list:
        """One id array per text of an Arrow string array; a null text has none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        unsure = pc.match_substring_regex(texts, UNSURE).fill_null(False)
        plain = [not u and (t is None or unicodedata.is_normalized("NFC", t))
                 for u, t in zip(unsure.to_pylist(), texts.to_pylist())]
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(plain), texts.fill_null(""), "")))
        bounds = words.offsets.to_numpy()
        codes = words.values[bounds[0]:bounds[-1]].dictionary_encode()
        chunks, codes = codes.dictionary, codes.indices.to_numpy()
        easy = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False)
        place = np.empty(len(chunks), np.int64)
        place[np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])] = np.arange(len(chunks))
        marked = joined(chunks.filter(pa.array(easy)))
        marked = marked.replace(",", END + ",").replace(".", END + ".").replace("\n", f"{END}\n{END}")
        odd = joined(chunks.filter(pa.array(~easy)))
        marked += "".join(f"{p}{END}" for p in PIECES.findall(odd))
        ids = self.fast.encode_to_numpy(marked).astype("<u4")
        ends = np.flatnonzero(ids == self.mark)
        begins = np.concatenate([[0], ends[:-1] + 1])
        codes = place[codes]
        sizes = (ends - begins)[codes]
        after = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(begins[codes] - after[:-1], sizes) + np.arange(after[-1])]
        cuts = after[bounds - bounds[0]].tolist()
        return [flat[a:b] if p else self.exact(t.as_py())
                for a, b, p, t in zip(cuts, cuts[1:], plain, texts)]


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; made once."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def blocks(texts, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of slices of an Arrow string array of about ``size`` bytes, at least one text each."""
    import numpy as np
    import pyarrow.compute as pc

    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + size, "right")))
        yield begin, end
        begin = end


def encode_all(path: str, texts) -> Iterator[tuple[int, "Iterable"]]:
    """(row, ids) of each text of an Arrow string array, block by block."""
    use = encoder(path)
    for begin, end in blocks(texts):
        yield from zip(range(begin, end), use.encode(texts.slice(begin, end - begin)))
