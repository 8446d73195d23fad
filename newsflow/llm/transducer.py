"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a state machine.

`sufficient_lookahead` finds from the merge list how far a change can reach to the left of where it happens:
text behind that point can only change a merge if it changes its right operand, that changes
merges of lower priority whose right operand is the left operand or the result, and so on. The longest such
chain bounds the reach. So tokens that end further back than that from the newest symbol are final: they
are emitted, and only the rest is held, however long the word.
"""

from __future__ import annotations

import codecs
import functools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import regex

from newsflow.llm.encoding import PieceEncoder, word_cuts


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """Symbols behind a place that settle the tokens before it, by the longest chain of merges (see above)."""
    reach: dict[str, int] = {}  # by right operand, over the merges of lower priority seen so far
    longest, token = 0, 1
    for left, right in reversed(merges):
        both = left + right
        own = length(left) + max(reach.get(left, 0), reach.get(both, 0))
        reach[right] = max(reach.get(right, 0), own)
        longest, token = max(longest, own), max(token, length(both))
    return longest + token


class Transducer:
    """Symbols of one word in, final tokens out; ``suffix`` marks a word's last symbol."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.suffix = suffix
        self.lookahead = sufficient_lookahead(merges, lambda s: len(s.removesuffix(suffix)) if suffix else len(s))

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges of highest priority first, leftmost first among equals."""
        rank, symbols = self.rank, list(symbols)
        none = len(rank)
        ranks = [rank.get(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((symbols[i], symbols[i + 1]), none)
        return symbols

    def short(self, letters: list[str]) -> list[str]:
        """Tokens of a word of at most twice the lookahead, of which nothing goes out before its end."""
        return self.merge([*letters[:-1], letters[-1] + self.suffix]) if letters else []

    def __call__(self, letters: Iterable[str]) -> Iterator[str]:
        """Tokens of one word; holds at most twice the lookahead, and one symbol to know the last."""
        held: list[str] = []
        most = 2 * self.lookahead
        for letter in letters:
            held.append(letter)
            if len(held) > most:
                # The last symbol may still get the suffix, so it is left out and counts as unknown text.
                tokens, end, stable = self.merge(held[:-1]), 0, len(held) - 1 - self.lookahead
                for token in tokens:
                    if end + len(token) > stable:
                        break
                    end += len(token)
                    yield token
                held = held[end:]
        if held:
            held[-1] += self.suffix
            yield from self.merge(held)


class BytePairTokenizer:
    """Encoding and decoding by a tokenizer file: optional normalisers, a split pattern, byte letters, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        normalizer = told["normalizer"] or {"type": "Sequence", "normalizers": []}
        self.normalizers = normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
        self.replaced = {s["pattern"]["Regex"]: regex.compile(s["pattern"]["Regex"]) for s in self.normalizers if s["type"] == "Replace"}
        pre = told["pre_tokenizer"]
        steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        patterns = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        # The byte-level step's own pattern, where no other is given.
        self.pattern = regex.compile(patterns[0] if patterns else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.letters = byte_letters()
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.byte_decoder = bool(told["decoder"])

    def normal(self, text: str) -> str:
        for step in self.normalizers:
            if step["type"] == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step["type"] == "Replace":
                text = self.replaced[step["pattern"]["Regex"]].sub(step["content"], text)
            elif step["type"] == "Lowercase":
                text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
            else:
                raise ValueError(f"no normaliser {step['type']}")
        return text

    def stream(self, text: str) -> Iterator[int]:
        """Ids of a text, one by one."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            for word in self.pattern.finditer(self.normal(part)):
                raw = word[0].encode()
                letters = map(self.letters.__getitem__, raw)
                tokens = self.transducer.short([*letters]) if len(raw) <= 2 * self.transducer.lookahead else self.transducer(letters)
                yield from map(self.vocab.__getitem__, tokens)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [list(self.stream(p)) for p in pieces]

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Ids in, text out, chunk by chunk. With a byte decoder the state is an unfinished UTF-8 character, else whether a token came before."""

    def __init__(self, tokenizer: BytePairTokenizer) -> None:
        self.token, self.bytes = tokenizer.token, tokenizer.byte_decoder
        self.byte = {letter: b for b, letter in enumerate(tokenizer.letters)}
        self.special = set(tokenizer.special)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        tokens = [self.token[i] for i in ids]
        if not tokens:
            return ""
        if not self.bytes:  # tokens as they are, with one space between them
            out = (" " if self.begun else "") + " ".join(tokens)
            self.begun = True
            return out
        raw = b"".join(t.encode() if t in self.special else bytes(map(self.byte.__getitem__, t)) for t in tokens)
        return self.state.decode(raw)

    def end(self) -> str:
        return self.state.decode(b"", True) if self.bytes else ""


@functools.lru_cache(maxsize=2)
def transducer_encoder(path: str) -> tuple[BytePairTokenizer, PieceEncoder]:
    """Tokenizer and piece table of a file whose pattern drops white space, kept between the tasks of a worker."""
    tokenizer = BytePairTokenizer(path)
    return tokenizer, PieceEncoder(path, word_cuts, tokenizer.encode_pieces)
