"""Byte-level tokens by a public tokenizer, with a bounded memory of units that came before."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Sequence

import numpy as np

#: Units remembered in a worker, and the longest one remembered.
MAX_UNITS = 200_000
MAX_UNIT_CHARS = 48
#: Units encoded as one text.
JOINED = 1000
# A single blank between two other characters always starts a new pre-token, so a text can be cut
# there and its parts encoded alone. Anything else stays inside a unit.
_CUT = re.compile(r"(?<=\S) (?=\S)")
# All white space but the blank and the line feed; the pre-token pattern of the byte-level
# tokenizers; the characters for which all versions of Unicode agree on that pattern's classes.
_RARE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile("[\n!-~¡-ſ]+")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(text: str) -> bool:
    """Whether every blank of a text can be cut at."""
    return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _RARE))


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: bytes that print stand for
    themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    return out | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Token bytes by rank, if the file is a byte-level BPE whose merges stand in the order of the ids.

    Merging by rank of the result then gives what merging by pair gives, if every merge is the last
    step of its own token; ``merges_are_canonical`` tells.
    """
    model = json.load(open(path, encoding="utf-8"))["model"]  # noqa: SIM115
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    alphabet, vocabulary, last = byte_alphabet(), model["vocab"], -1
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        now = vocabulary[a + b]
        if now <= last:
            return None
        last = now
    if any(c not in vocabulary for c in alphabet):
        return None
    return {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if i <= last and all(c in alphabet for c in t)}


def added_strings(path: str) -> list[str]:
    return [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens") or [] if t["content"]]  # noqa: SIM115


def added_tokens(path: str) -> tuple[re.Pattern, dict[str, bytes] | None] | None:
    """A pattern that cuts texts at added tokens, and the id of each; None without any.

    Ids are None where a token is matched in ways that the pattern does not follow (stripping, whole
    words, normalised text): the tokenizer then takes texts that hold one whole.
    """
    model = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
    added = [t for t in model.get("added_tokens") or [] if t["content"]]
    if not added:
        return None
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    plain = plain and (not model.get("normalizer") or not any(t.get("normalized") for t in added))
    pattern = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")")
    return pattern, {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added} if plain else None


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    Strings of added tokens in a text are those tokens, as the tokenizer has it: the text is cut at them
    first. Units of Latin text are encoded many at once by rank; all else, and every first unit of a part,
    by the tokenizer itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._added = added_tokens(path)
        self._openers = added_strings(path)
        self._fast = None
        if ranks := ranks_of(path):
            import tiktoken

            self._fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._opens = np.zeros(max(ranks.values()) + 1, bool)
            self._opens[[i for t, i in ranks.items() if t.startswith(b" ")]] = True

    def _encode(self, units: list[str]) -> list[bytes]:
        from array import array

        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of units behind a blank. Those without a blank inside are encoded many as one text, and told
        apart by the one token of each that starts with a blank."""
        out: dict[str, bytes] = {}
        if self._fast:
            easy = [u for u in units if _LATIN.fullmatch(u)]
            for i in range(0, len(easy), JOINED):
                group = easy[i : i + JOINED]
                ids = self._fast.encode_to_numpy(" " + " ".join(group), disallowed_special=()).astype("<u4")
                start = np.flatnonzero(self._opens[ids])
                if len(start) == len(group):
                    raw, cut = ids.tobytes(), [*(4 * start).tolist(), 4 * len(ids)]
                    out.update(zip(group, (raw[a:b] for a, b in itertools.pairwise(cut)), strict=True))
        rest = [u for u in units if u not in out]
        out.update(zip(rest, self._encode([" " + u for u in rest]), strict=True))
        return [out[u] for u in units]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        if not self._added:
            return self._encode_plain(texts)
        pattern, ids = self._added
        parts: list[str] = []
        plan: list[int | list] = []  # the place of a text without added tokens, or its parts
        for text in texts:
            text = text or ""
            cut = pattern.split(text) if any(c in text for c in self._openers) else [text]
            if len(cut) == 1:
                plan.append(len(parts))
                parts.append(text)
            elif ids is None:
                plan.append([self._encode([text])[0]])
            else:
                whole: list = []
                for i, part in enumerate(cut):
                    if i % 2:
                        whole.append(ids[part])
                    elif part:
                        whole.append(len(parts))
                        parts.append(part)
                plan.append(whole)
        done = self._encode_plain(parts)
        return [done[x] if isinstance(x, int) else b"".join(done[y] if isinstance(y, int) else y for y in x) for x in plan]

    def _encode_plain(self, texts: Sequence[str | None]) -> list[bytes]:
        known = self._known
        if len(known) > MAX_UNITS:
            known.clear()
        parts = []
        new: set[str] = set()
        for text in texts:
            text = text or ""
            units = text.split(" ") if _plain(text) else _CUT.split(text)
            parts.append(units)
            new.update(units[1:])
        new -= known.keys()
        fresh = list(new)
        known.update(zip(fresh, self._encode_units(fresh), strict=True))
        firsts = self._encode([units[0] for units in parts])
        out = [first + b"".join(map(known.__getitem__, units[1:])) for first, units in zip(firsts, parts, strict=True)]
        for u in fresh:
            if len(u) > MAX_UNIT_CHARS:
                del known[u]
        return out


def merges_are_canonical(path: str) -> bool:
    """Whether merging each token's bytes by rank, up to its last step, leaves the two parts that its own
    merge joins. Then merging by rank and merging by pair always agree."""
    ranks = ranks_of(path)
    if not ranks:
        return False
    alphabet = byte_alphabet()
    for m in json.load(open(path, encoding="utf-8"))["model"]["merges"]:  # noqa: SIM115
        a, b = (bytes(alphabet[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
        parts = [bytes([c]) for c in a + b]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= ranks[a + b]:
                return False
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if parts != [a, b]:
            return False
    return True
