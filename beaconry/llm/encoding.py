"""Token ids of whole texts with a public tokenizer of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from typing import Any

import numpy as np

from beaconry.llm.common import KEPT

VOCABULARY = "word_bpe_49k.json"
#: Pieces whose ids a worker keeps; beyond it the store starts anew from one batch, results stay the same.
KEPT_PIECES = 400_000
#: Longer pieces are encoded each time they come.
LONGEST_KEPT = 64
#: Pieces that go through the library in one text.
TOGETHER = 512
#: Texts with other characters, or with the start of a special token, are cut at white space only.
ODD = re.compile("[^\t-\r -~¡-¬®-įı-ž]|<\\|")
#: White space for ``str.split`` but not for the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The cut of the vocabulary, fixed by its file, and the same cut for lower-case texts that are not odd, most frequent first:
#: no two alternatives but the last two begin alike.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_CUT = re.compile(
    r"[a-zªµºß-öø-ž]+|[0-9²³¹¼-¾]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9ªµºß-öø-ž²³¹¼-¾]+")
WORD_END = "</w>"


def encoder(path: str | None = None) -> "WordEncoder":
    """One encoder per worker and vocabulary. ``path`` None: the public word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in KEPT:
        KEPT[path] = WordEncoder(path)
    return KEPT[path]


def _cuts_plainly(spec: dict) -> bool:
    """Whether a vocabulary lower-cases, cuts by ``CUT`` and marks the last token of a piece."""
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and cuts[:1] == [CUT] and (
        spec["model"].get("end_of_word_suffix") == WORD_END)


def _of_pieces(spec: dict) -> dict:
    """The same vocabulary for plain pieces, which need no normalizing and are cut at the white space between them."""
    cuts = [{"type": "WhitespaceSplit"}, *spec["pre_tokenizer"]["pretokenizers"][1:]]
    return {**spec, "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": cuts}}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    For a vocabulary whose tokens never span white space: a text's ids are those of its pieces in turn, so each
    distinct piece goes through the library once while it is kept. Pieces are the tokenizer's own where the text
    holds plain letters only, else words; a text with control separators goes whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known: dict[str, bytes] = {}
        self.plain = _cuts_plainly(spec)
        self.of_pieces = Tokenizer.from_str(json.dumps(_of_pieces(spec))) if self.plain else self.tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _encode(self, texts: list[str], tokenizer: Any = None) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> Iterable[bytes]:
        """Many pieces as one text, cut again behind each token that ends a piece."""
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at:at + TOGETHER]
            raw = self._encode([" ".join(some)], self.of_pieces)[0]
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1)).tolist()
            if len(stops) == len(some):
                yield from (raw[i:j] for i, j in zip([0, *stops], stops))
            else:
                yield from self._encode(some)

    def _split(self, text: str) -> tuple[list[str] | None, bool]:
        if self.plain and not ODD.search(text):
            return PLAIN_CUT.findall(text.lower()), True
        return (None if SEPARATORS.search(text) else text.split()), False

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.known.get
        split = [self._split(t) for t in texts]
        found = [None if some is None else list(map(get, some)) for some, _ in split]
        pieces: set[str] = set()
        words: set[str] = set()
        for (some, plain), ids in zip(split, found):
            if ids and None in ids:
                (pieces if plain else words).update(w for w, x in zip(some, ids) if x is None)
        # a plain piece on its own is also a word, with the same ids
        words -= pieces
        if len(self.known) + len(pieces) + len(words) > KEPT_PIECES:
            # frequent pieces are in any batch: those of this one stay
            self.known = {}
            for (some, _), ids in zip(split, found):
                self.known.update((w, x) for w, x in zip(some or (), ids or ()) if x is not None)
            get = self.known.get
        for new, encoded in ((list(pieces), self._encode_pieces), (list(words), self._encode)):
            self.known.update(zip(new, encoded(new)))
        whole = iter(self._encode([t for t, (some, _) in zip(texts, split) if some is None]))
        out = []
        for (some, _), ids in zip(split, found):
            if ids is None:
                out.append(next(whole))
            elif None in ids:
                out.append(b"".join([get(w) if x is None else x for w, x in zip(some, ids)]))
            else:
                out.append(b"".join(ids))
        for w in (*pieces, *words):
            if len(w) > LONGEST_KEPT:
                del self.known[w]
        return out
