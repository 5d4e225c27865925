"""Language identification by compression: the language whose zstandard dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean

#: Bytes of text in a language's dictionary, and the training texts that may be fetched for it: the bounds of the fit.
DICTIONARY_BYTES = 64 * 1024
TEXTS_PER_LANGUAGE = 300
#: Code points of a training text that go into a dictionary at most, so that no long text fills it alone; a hash picks where in the text.
PIECE = 2000
#: A language whose dictionary is smaller than this share of the largest must win clearly, by MIN_MARGIN, and doesn't narrow the margin of others.
SMALL_SHARE = 0.25
#: Bytes of a text that are encoded as one frame: all of a text is encoded, frame by frame.
BLOCK = 2048
#: A text is rejected if the runner-up needs less than this much more than the best.
MIN_MARGIN = 0.01
UNKNOWN = "und"
#: Combining marks belong to their letters: vowel signs, viramas, accents of decomposed texts. Most texts have none, so the wider classes are used where they are needed.
_MARKS = [c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c)[0] == "M"]
_COMMON_MARKS = "".join(c for c in _MARKS if c < "\U00010000")
_HAS_MARK, _HAS_RARE = re.compile(f"[{_COMMON_MARKS}]"), re.compile("[\U00010000-\U0001efff]")
_OTHER = re.compile(r"[\W\d_]+")
_OTHER_BUT_MARKS, _OTHER_BUT_ALL_MARKS = (re.compile(rf"(?:[^\w{marks}]|[\d_])+") for marks in (_COMMON_MARKS, "".join(_MARKS)))


def plain(text: str) -> str:
    """The lower-cased letters of a text with their marks, composed where they can be, and one space for whatever stands between them."""
    text = unicodedata.normalize("NFC", text.lower())
    other = _OTHER_BUT_ALL_MARKS if _HAS_RARE.search(text) else _OTHER_BUT_MARKS if _HAS_MARK.search(text) else _OTHER
    return other.sub(" ", text)


def has_letter(text: str) -> bool:
    """Whether a text has a character of a Unicode letter category; fractions and other numbers are none."""
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Dictionary text of each language, and how many rows taught it."""

    texts: dict[str, bytes]
    rows: dict[str, int]

    def coders(self) -> Coders:
        return Coders(self)


class Coders:
    """Encoders of a model's languages, made as they are asked for.

    A language with a smaller dictionary than the largest is compared with an equally long slice of the best language's so far.
    """

    def __init__(self, model: LanguageModel):
        self.texts = model.texts
        self.names = sorted(model.texts, key=lambda x: (-model.rows[x], x))
        self.levels = [(room, [x for x in self.names if len(self.texts[x]) == room]) for room in sorted({len(x) for x in self.texts.values()}, reverse=True)]
        self.made: dict[tuple[str, int], zstandard.ZstdCompressor] = {}

    def _coder(self, name: str, room: int) -> zstandard.ZstdCompressor:
        found = self.made.get((name, room))
        if found is None:
            data = self.texts[name][:room]
            log = max(10, min(16, len(data).bit_length()))
            setting = zstandard.ZstdCompressionParameters(window_log=log + 1, chain_log=log, hash_log=log, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=setting)
            found = self.made[name, room] = zstandard.ZstdCompressor(compression_params=setting, dict_data=d)
        return found

    def sizes(self, text: str) -> list[float]:
        """Encoded bytes of a text for each of `names`, those of smaller dictionaries in proportion to the equal slice.

        Each block is written twice: the copy costs little, but without it the encoder would keep short texts as they are,
        whatever the dictionary.
        """
        data = plain(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] * 2 for i in range(0, len(data), BLOCK)]

        def size(name: str, room: int) -> float:
            c = self._coder(name, room)
            return float(sum(len(c.compress(b)) for b in blocks))

        got: dict[str, float] = {}
        best, top = "", self.levels[0][0] if self.levels else 0
        for room, level in self.levels:
            if best:
                base = size(best, room)
                for name in level:
                    ratio = size(name, room) / base
                    if room < SMALL_SHARE * top and ratio > 1 - MIN_MARGIN:
                        ratio = max(ratio, 1 + 2 * MIN_MARGIN)
                    got[name] = got[best] * ratio
            else:
                got = {name: size(name, room) for name in level}
            best = min((x for x in self.names if x in got), key=got.__getitem__)
        return [got[x] for x in self.names]


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts_per_language: int = TEXTS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> LanguageModel:
    """Dictionaries from a bounded sample of labelled rows: about `texts_per_language` of each language, by a hash of the key.

    Rows without text or language teach nothing. Repeated texts go in once. Each language has up to `dictionary_bytes`, however
    little others have. With no labelled row the model knows no language.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel({}, {})
    draw = F.shiftrightunsigned(F.xxhash64("key", F.lit("language")), 11) / F.lit(float(2**53))
    keep = F.lit(False)
    for name, n in counts.items():
        keep = keep | ((F.col("lang") == F.lit(name)) & (draw < F.lit(texts_per_language / n)))
    # Of the text, not the key, so that copies give one piece. The last piece ends with the text.
    pieces = F.greatest(F.ceil(F.length("text") / PIECE), F.lit(1))
    start = F.least(F.pmod(F.xxhash64("text", F.lit("piece")), pieces) * PIECE, F.greatest(F.length("text") - PIECE, F.lit(0))) + 1
    rows = known.where(keep).select("lang", F.substring("text", start.cast("int"), F.lit(PIECE)).alias("piece"), draw.alias("draw")).distinct().collect()
    parts: dict[str, list[bytes]] = {name: [] for name in counts}
    size = dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r["lang"], r["draw"], r["piece"])):
        b = plain(r["piece"]).encode()
        if size[r["lang"]] <= dictionary_bytes and b not in parts[r["lang"]]:
            parts[r["lang"]].append(b)
            size[r["lang"]] += len(b) + 1
    texts = {name: b" ".join(p)[:dictionary_bytes] for name, p in parts.items()}
    return LanguageModel({name: x for name, x in texts.items() if x.strip()}, counts)


def decide(names: list[str], got: list[float], letters: bool) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) from the encoded sizes."""
    if not letters or not names:
        return UNKNOWN, 0.0, 0.0, True
    order = sorted(range(len(names)), key=lambda i: (got[i], i))
    best = got[order[0]]
    score = 1.0 / sum(math.exp(-min(700.0, 0.5 * (x - best))) for x in got)
    margin = (got[order[1]] - best) / got[order[1]] if len(names) > 1 else 1.0
    return names[order[0]], score, margin, margin < MIN_MARGIN


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), flags_as: str = "") -> DataFrame:
    """The columns of `keep`, lang_pred, score, margin and rejected for each row, over the whole text.

    A null or empty text, or one without a letter, is `und` with score 0 and rejected, as is every text under a model of no
    language. A text of whatever length whose margin is below MIN_MARGIN keeps its best language but is rejected.
    A language of little training text is compared with equal slices of the others and must win clearly.
    Equal sizes go to the language with more training rows. Repeated rows get equal results. Very long texts are encoded
    block by block to their end. `flags_as` goes before the new columns' names, for tables that have such columns. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    new = [flags_as + c for c in ("lang_pred", "score", "margin", "rejected")]
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(c, k) for c, k in zip(new, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = shared.value.coders()
        names = coders.names
        for batch in batches:
            got = []
            for t in batch.column("__text"):
                s = t.as_py() or ""
                letters = has_letter(s)
                got.append(decide(names, coders.sizes(s) if letters else [], letters))
            cols = list(zip(*got, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*keep, *new])

    return rows.mapInArrow(run, schema)
