"""BPE encoding by a streaming transducer with bounded lookahead, and decoding by a state machine.

A merge list has a lookahead that is sufficient for it: once so many further symbols have been read, the
tokens before them cannot change any more (``Merges.lookahead``). The transducer keeps, for each of the
symbols it still holds, the last token of the encoding of the input up to there; when it holds more than
twice the lookahead it walks back from the newest symbol, emits what is stable and forgets it. So memory is
constant, however long a run of letters is.

The last token of a prefix is the one candidate that stands well after the last token of the prefix before
it: two tokens stand well side by side if encoding their joined symbols gives these two again. Candidates are
the tokens that end there; an automaton tells them, made as far as the texts ask for it.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Encoded words that a worker remembers; beyond it starts anew. No longer word is remembered.
MEMO_WORDS, MEMO_LENGTH = 400_000, 32
#: Steps from state to state that a worker remembers; beyond it starts anew.
MEMO_STEPS = 200_000
# fixed values: Unicode's white space, without the separators 0x1c to 0x1f that Python's \s adds
WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


# fixed values: letters and numbers that Unicode 16 added, in hexadecimal; Python's own tables end before
NEW_LETTERS = """1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b
1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c
18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"""
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
# fixed values: capital letters that Unicode 16 and 17 added, in hexadecimal, with how far off their small letters are
NEW_CAPITALS = """1c89-1c89+1 a7cb-a7cb-a567 a7cc-a7cc+1 a7ce-a7ce+1 a7d2-a7d2+1 a7d4-a7d4+1 a7da-a7da+1 a7dc-a7dc-a641
10d50-10d65+20 16ea0-16eb8+1b"""


def _new_small() -> dict[int, int]:
    """The small letter of each of the new capitals."""
    out = {}
    for lo, hi, off in re.findall(r"(\w+)-(\w+)([+-]\w+)", NEW_CAPITALS):
        out |= {c: c + int(off, 16) for c in range(int(lo, 16), int(hi, 16) + 1)}
    return out


def _listed(ranges: str) -> str:
    """Ranges in hexadecimal as the inside of a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split())


def byte_symbols() -> list[str]:
    """A printable character for each byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _ranges(wanted: Callable[[str], bool]) -> str:
    """The characters that ``wanted`` accepts, as the inside of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        ok = c <= sys.maxunicode and wanted(chr(c))
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(out)


class Merges:
    """The merge list of a vocabulary file, with what the transducer needs to know of it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = [""] * (1 + max((self.ids | self.special).values()))
        for token, i in (self.ids | self.special).items():
            self.names[i] = token
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            pair, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.rank.setdefault(pair, (k, made))
            self.parts.setdefault(made, pair)
        self.raw = {c: b for b, c in enumerate(byte_symbols())}
        self.longest = max(map(self.width, self.ids))
        self.lookahead = self._lookahead()
        self.known: dict[tuple[int, int], bool] = {}

    def width(self, token: str) -> int:
        """Symbols of a token: the end mark is part of the last."""
        return len(token.removesuffix(self.end)) if self.end and token != self.end else len(token)

    def _lookahead(self) -> int:
        """How many symbols from a token's start any chain of overlapping merges can reach.

        A merge can lose its end to one of an earlier rank that begins inside it, this one to a still
        earlier one, and so on; what lies beyond every such chain cannot change the token.
        """
        from_prefix: dict[str, int] = {}
        most = 1
        for made in self.parts:  # in order of rank
            token = self.names[made]
            body = token.removesuffix(self.end)
            reach = len(body)
            if body == token:
                reach = max([reach, *(i + r for i in range(1, len(body)) if (r := from_prefix.get(body[i:])))])
            most = max(most, reach)
            for i in range(1, len(body)):
                if from_prefix.get(body[:i], 0) < reach:
                    from_prefix[body[:i]] = reach
        return most + self.longest

    def merge(self, tokens: list[int]) -> list[int]:
        """The plain definition: the earliest merge first, leftmost first."""
        while len(tokens) > 1:
            k, made, at = min((*self.rank.get(p, (len(self.rank) + 1, -1)), i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)))
            if made < 0:
                break
            tokens = [*tokens[:at], made, *tokens[at + 2 :]]
        return tokens

    def stands(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no merge across their border comes before those that made them."""
        if len(self.known) > 500_000:
            self.known.clear()
        found = self.known[a, b] = self._stands(a, b)
        return found

    def _stands(self, a: int, b: int) -> bool:
        """Undo merges on both sides, latest first, and look whether the border's merge would have come earlier."""
        never = len(self.rank) + 1
        left, right, limit = a, b, never
        rank, parts = self.rank, self.parts
        while True:
            k, _ = rank.get((left, right), (never, -1))
            if k < limit:
                return False
            # step back in time: undo the later of the merges that made the two tokens at the border
            rl = rank[parts[left]][0] if left in parts else -1
            rr = rank[parts[right]][0] if right in parts else -1
            if rl < 0 and rr < 0:
                return True
            if rl > rr:
                limit, left = rl, parts[left][1]
            else:
                # a merge of the same rank at the border starts further left than the right token's own
                limit, right = rr + 1, parts[right][0]


def _ends(text: str, tokens: dict[str, int]) -> tuple[tuple[int, int], ...]:
    """The tokens with which a text ends, as (id, width), the widest first."""
    return tuple((t, len(text) - k) for k in range(len(text)) if (t := tokens.get(text[k:])) is not None)


class _State:
    """How the symbols read so far end: in ``text``, the longest end with which a token begins.

    ``found``: the tokens that end here and their widths, the widest first; ``then`` and ``last``: the state and the tokens
    after each next symbol that was met, the latter for a word's last one.
    """

    __slots__ = ("found", "last", "text", "then")

    def __init__(self, text: str, found: tuple[tuple[int, int], ...]):
        self.text, self.found = text, found
        self.then: dict[str, _State] = {}
        self.last: dict[str, tuple[tuple[int, int], ...]] = {}


class Encoder:
    """The transducer over one word's symbols, a character each; yields ids once they are stable."""

    def __init__(self, merges: Merges):
        self.m, self.keep = merges, 2 * merges.lookahead
        self.inner = {t: i for t, i in merges.ids.items() if not merges.end or not t.endswith(merges.end)}
        self.closing = {t.removesuffix(merges.end): i for t, i in merges.ids.items() if t.endswith(merges.end)}
        self.begins = {t[:k] for tokens in (self.inner, self.closing) for t in tokens for k in range(1, len(t) + 1)}
        self._anew()

    def _anew(self) -> None:
        self.states: dict[str, _State] = {}
        self.steps, self.root = 0, _State("", ())

    def _step(self, state: _State, symbol: str) -> _State:
        """The state after one more symbol, remembered; beyond ``MEMO_STEPS`` what is remembered starts anew."""
        if self.steps >= MEMO_STEPS:
            self._anew()
        self.steps += 1
        text = state.text + symbol
        while text and text not in self.begins:
            text = text[1:]
        after = self.states.get(text)
        if after is None:
            after = self.states[text] = _State(text, _ends(text, self.inner))
        state.then[symbol] = after
        return after

    def _last(self, state: _State, symbol: str) -> tuple[tuple[int, int], ...]:
        """The tokens that end in a word's last symbol, remembered likewise."""
        if self.steps >= MEMO_STEPS:
            self._anew()
        self.steps += 1
        found = state.last[symbol] = _ends(state.text + symbol, self.closing)
        return found

    def word(self, symbols: str) -> Iterator[int]:
        """Ids of one word; the end mark is added here. Never holds more than ``keep`` symbols."""
        m, at, held, state = self.m, 0, "", self.root
        last, wide, before = [-1], [0], -1  # last[i]: the last token up to held[:i]; before: the last one emitted
        while True:
            room = self.keep - len(held)
            held, at = held + symbols[at : at + room], at + room
            closed = at >= len(symbols)
            state = self._advance(held, closed, last, wide, before, state)
            if closed:
                yield from (t for t, _ in self._walk(last, wide, len(held)))
                return
            done = [x for x in self._walk(last, wide, len(held)) if x[1] <= len(held) - m.lookahead]
            yield from (t for t, _ in done)
            before, cut = done[-1]
            held = held[cut:]
            del last[1 : cut + 1], wide[1 : cut + 1]

    def _advance(self, held: str, closed: bool, last: list[int], wide: list[int], before: int, state: _State) -> _State:
        """The last token of each longer prefix of ``held``, whose known part ends in ``state``; the state at its end."""
        well, stands = self.m.known.get, self.m.stands
        n, size = len(last), len(held)
        for symbol in held[n - 1 :]:
            if n == size and closed:
                found = state.last.get(symbol)
                if found is None:
                    found = self._last(state, symbol)
            else:
                after = state.then.get(symbol)
                state = self._step(state, symbol) if after is None else after
                found = state.found
            for t, width in found:
                if width < n:
                    prior = last[n - width]
                elif width > n:
                    continue
                elif before < 0:
                    break
                else:
                    prior = before
                ok = well((prior, t))
                if stands(prior, t) if ok is None else ok:
                    break
            else:
                raise ValueError(f"no token ends in {symbol!r}")
            last.append(t)
            wide.append(width)
            n += 1
        return state

    @staticmethod
    def _walk(last: list[int], wide: list[int], at: int) -> list[tuple[int, int]]:
        out = []
        while at > 0:
            out.append((last[at], at))
            at -= wide[at]
        return out[::-1]


class Decoder:
    """Ids to text, piece by piece; holds at most one unfinished character.

    With ``spell_bytes`` tokens are bytes spelled as characters and an end mark becomes a space. Without it the
    tokens' own strings are joined by a space, which is what a vocabulary file without a decoder asks for.
    """

    def __init__(self, merges: Merges, spell_bytes: bool = False):
        self.m, self.spell, self.first = merges, spell_bytes, True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        if not self.spell:
            text = " ".join(map(self.m.names.__getitem__, ids))
            out = text if self.first or not text else " " + text
            self.first = self.first and not text
            return out
        out = []
        for i in ids:
            token = self.m.names[i]
            if token in self.m.special:
                out.append(self.state.decode(b"", True) + token)
                continue
            body = token.removesuffix(self.m.end)
            out.append(self.state.decode(bytes(map(self.m.raw.__getitem__, body))))
            if body != token:
                out.append(self.state.decode(b" "))
        return "".join(out) + self.state.decode(b"", final)


class Tokenizer:
    """Whole texts to ids: special strings, normal form, words, and each word's ids by the transducer."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.encoder = Encoder(self.merges)
        self.spelled = byte_symbols()
        more = _listed(NEW_LETTERS)
        numbers = _ranges(lambda c: unicodedata.category(c) in ("Nl", "No")) + _listed(NEW_NUMBERS)
        letters, number = rf"(?:[^\W\d_{numbers}]|[{more}])+", rf"[\d{numbers}]"
        # fixed values: the contractions of the vocabulary file's pattern
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letters}|{number}|(?:_|[^\w{WHITE}{numbers}{more}])+")
        self.special = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        self.odd_space = re.compile("[\x1c-\x1f]")  # str.split() parts words there too
        self.small = _new_small()
        self.capitals = re.compile(f"[{''.join(map(chr, self.small))}]")
        self.memo = _Memo(self)

    def word_ids(self, word: str) -> tuple[int, ...]:
        return tuple(self.encoder.word("".join(map(self.spelled.__getitem__, word.encode("utf-8", "replace")))))

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.capitals.search(text):
                text = text.translate(self.small)
        text = text.lower()
        # white space always parts words, so that what stands between is looked up whole
        pieces = text.split() if not self.odd_space.search(text) else self.words.findall(text)
        return list(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; an empty one has none."""
        if self.special is None or not self.special.search(text):
            return list(chain.from_iterable(self._plain(text)))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += chain.from_iterable(self._plain(text[at : m.start()]))
            out.append(self.merges.special[m[0]])
            at = m.end()
        return [*out, *chain.from_iterable(self._plain(text[at:]))]


class _Memo(dict):
    """Ids of pieces without white space seen lately, bounded; very long ones are never kept."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> tuple[int, ...]:
        words = self.tokenizer.words.findall(word)
        if words == [word]:
            ids = self.tokenizer.word_ids(word)
        else:
            ids = tuple(chain.from_iterable(map(self.__getitem__, words)))
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, once for each worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def _whole(ids: list[list[int]], texts: list[str]) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(texts)]


DECIMAL = [str(i) for i in range(1 << 17)]


def _digests(ids: list[list[int]], texts: list[str]) -> list[pa.Array]:
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha256(" ".join(map(DECIMAL.__getitem__, x)).encode()).hexdigest() for x in ids]),
        pa.array([sha256(x.encode()).hexdigest() for x in texts]),
    ]


#: What becomes of each batch's ids and decoded texts: the columns and the function that makes them.
FORMS = {"whole": ("ids array<int>, decoded string", _whole), "digests": ("n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)}


def encode_decode(df: DataFrame, text: str, path: str, *carry: str, form: str = "whole", spell_bytes: bool = False) -> DataFrame:
    """``*carry`` and, by ``form``, the ids and decoded text of each whole text, or the digests of both.

    ``path`` names a vocabulary file that every executor can read. Null text: as empty, no ids, decoded to an
    empty text. Repeated rows give repeated results; an empty table an empty one; other columns are left out.
    """
    small_batches(df.sparkSession)
    schema, finish = FORMS[form]
    names = [x.split()[0] for x in schema.split(", ")]
    rows = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kinds = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(rows.schema.fields[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = [t.encode(x) for x in part.column(part.num_columns - 1).to_pylist()]
                texts = [Decoder(t.merges, spell_bytes).feed(x, final=True) for x in ids]
                made = finish(ids, texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *names])

    return rows.mapInArrow(run, kinds + schema).toDF(*carry, *names)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files have ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, "text", vocabulary(), "doc_id", form="digests")
