"""Language identification as mixture inference: expectation-maximisation over n-gram likelihoods, languages chosen by penalised likelihood."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import small_batches, trimmed

UNKNOWN = "und"
#: Documents of each language that the n-gram counts are taken from, at most (about; they are chosen by hash).
SAMPLE = 4000
CODES = 1 << 18
_BITS = 6


def _classes() -> np.ndarray:
    """A byte's class of 6 bits: letters fold their case, ASCII that is no letter parts words, bytes of other letters get what is left."""
    out = np.zeros(256, np.int32)
    for b in range(256):
        if 65 <= (b & 0xDF) <= 90:
            out[b] = (b & 31)
        elif b >= 128:
            out[b] = 27 + (b * 7) % 37
    return out


_CLASS = _classes()


def trigrams(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, count), sorted: the distinct 3-grams of classes around every letter of every whole text. Counted
    in parts of about `most` bytes, so a long text needs no more room than many short ones."""
    found = []
    for at, part in _pieces(texts, most):
        size = np.fromiter(map(len, part), np.int64, len(part))
        flat = _CLASS[np.frombuffer(b"".join(part), np.uint8)]
        doc = np.repeat(np.array(at, np.int64), size)
        middle = flat[1:-1] != 0
        end = np.cumsum(size)
        middle[end[:-1] - 1] = middle[end[:-1] - 2] = False  # the first and last byte of a piece only stand beside letters
        code = (flat[:-2] << (2 * _BITS)) | (flat[1:-1] << _BITS) | flat[2:]
        key, n = np.unique((doc[1:-1][middle] << 18) | code[middle], return_counts=True)
        found.append((key, n))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    key, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    if len(found) > 1 and key.size:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[new], np.add.reduceat(n, new)
    return key >> 18, key & (CODES - 1), n


def _pieces(texts: list[bytes], most: int):
    """(documents, pieces) of about `most` bytes: the bytes of a text, or a part of one, with the byte before and the byte after."""
    at, held, n = [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), most):
            own = (t[a - 1 : a] if a else b"\n") + t[a : a + most] + (t[a + most : a + most + 1] or b"\n")
            if n and n + len(own) > most:
                yield at, held
                at, held, n = [], [], 0
            at.append(i)
            held.append(own)
            n += len(own)
    if held:
        yield at, held


def _parts(column, most: int = 1 << 20):
    """A batch's texts as bytes, in parts of a bounded size; one text larger than that is a part of its own."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    a = n = 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield a, texts[a:i]
            a, n = i, 0
        n += len(t)
    if texts:
        yield a, texts[a:]


def is_training(c="doc_id"):
    """Documents to learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % 4 != 2


class Model:
    """log p(3-gram | language) in a table of CODES rows."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.languages = languages
        seen = np.maximum(1, (counts.sum(1) > 0).sum())
        p = (counts + smooth) / (counts.sum(0) + smooth * seen)
        self.p = p.astype(np.float32)


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Counts 3-grams by language over a sample of the labelled rows given: about `sample` whole documents of each
    language, chosen by a hash of the id (all where there are fewer). The counts meet on the driver: languages x CODES."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t"), F.col(lang_col).cast("string").alias("_l"))
    have = {r["_l"]: r["n"] for r in rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(have)
    if not languages:
        return Model([], np.zeros((CODES, 0)))
    share = F.lit(0.0)
    for name, n in have.items():
        share = F.when(F.col("_l") == name, min(1.0, sample / n)).otherwise(share)
    rows = rows.where((F.pmod(F.xxhash64("_i"), F.lit(1 << 30)) / (1 << 30)) < share)
    place = {name: i for i, name in enumerate(languages)}

    def count(batches):
        for b in batches:
            names = b.column("_l").to_pylist()
            for a, texts in _parts(b.column("_t")):
                doc, code, n = trigrams(texts)
                lang = np.array([place[x] for x in names[a : a + len(texts)]], np.int64)[doc] if len(doc) else doc
                key, at = np.unique((lang << 18) | code, return_inverse=True)
                total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], names=["key", "n"])

    found = rows.mapInArrow(trimmed(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((CODES, len(languages)))
    key = found.column("key").to_numpy()
    counts[key & (CODES - 1), key >> 18] = found.column("n").to_numpy()
    return Model(languages, counts)


def mixture(p: np.ndarray, doc: np.ndarray, n: np.ndarray, docs: int, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for each document at once: the languages' shares and the log likelihood. p: likelihoods of the rows' 3-grams
    under each language; rows sorted by document; allowed: which languages a document may have."""
    share = allowed / np.maximum(1, allowed.sum(1, keepdims=True)).astype(np.float32)
    cut = np.searchsorted(doc, np.arange(docs))
    some = np.flatnonzero(np.diff(np.append(cut, len(doc))) > 0)
    total = np.zeros(docs)
    total[some] = np.add.reduceat(n, cut[some]) if some.size else 0
    like = np.zeros(docs)
    n4 = n.astype(np.float32)
    for k in range(rounds + 1):
        r = p * share[doc]
        z = r.sum(1)
        if k == rounds:
            if some.size:
                like[some] = np.add.reduceat(n * np.log(np.maximum(z, 1e-30)), cut[some])
            break
        r *= (n4 / np.maximum(z, 1e-30))[:, None]
        new = np.zeros_like(share)
        if some.size:
            new[some] = np.add.reduceat(r, cut[some]) / total[some, None]
        share = new
    return share, like


def infer(model: Model, texts: list[bytes], rounds: int = 12, penalty: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """(shares, chosen) of each text. EM over all languages ranks them; then for k = 1, 2, .. the k first are fitted alone,
    and the k of the largest log likelihood less penalty * k * log(3-grams) is chosen. The k end where no document can gain:
    no mixture is likelier than each 3-gram under its likeliest language."""
    docs, L = len(texts), len(model.languages)
    doc, code, n = trigrams(texts)
    p = model.p[code]
    full, _ = mixture(p, doc, n, docs, np.ones((docs, L), np.float32), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    size = np.bincount(doc, weights=n, minlength=docs)
    best, shares, score = np.zeros(docs, int), np.zeros((docs, L), np.float32), np.full(docs, -np.inf)
    some, cut = np.unique(doc, return_index=True)
    limit = np.zeros(docs)
    if some.size:
        limit[some] = np.add.reduceat(n * np.log(np.maximum(p.max(1), 1e-30)), cut) + 1e-6 * size[some]
    for k in range(1, L + 1):
        if (limit - penalty * k * np.log(np.maximum(size, 2)) <= score).all():
            break
        allowed = np.zeros((docs, L), np.float32)
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        got, like = mixture(p, doc, n, docs, allowed, 0 if k == 1 else rounds // 2)
        value = like - penalty * k * np.log(np.maximum(size, 2))
        better = value > score
        best[better], shares[better], score[better] = k, got[better], value[better]
    return shares, best


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus lang_pred, score (the language's share, 0 to 1) and languages (the chosen set with shares, largest first).

    Only the text is looked at, all of it. Null, empty or letterless text: `und`, score 0, no languages; so it is
    where the model knows no language. A tie goes to the first language by name. Other columns pass through;
    columns of the three new names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    schema = docs.select(*kept).schema
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast((model.languages, model.p))  # languages x CODES floats: bounded by the model

    def run(batches):
        m = Model.__new__(Model)
        m.languages, m.p = table.value
        for b in batches:
            pred, score, sets = [], [], []
            for _, texts in _parts(b.column(text_col), max(1 << 16, (1 << 23) // max(8, len(m.languages)))):  # arrays are bytes x languages
                shares, _ = infer(m, texts) if m.languages else (np.zeros((len(texts), 0)), None)
                letters = np.fromiter(((x != 0) for x in shares.sum(1)), bool, len(texts)) if m.languages else np.zeros(len(texts), bool)
                top = shares.argmax(1) if m.languages else np.zeros(len(texts), int)
                for i, t in enumerate(texts):
                    if not m.languages or not letters[i] or not (_LETTER(t) or _has_letter(t)):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        sets.append([])
                        continue
                    pred.append(m.languages[top[i]])
                    score.append(min(1.0, max(0.0, float(shares[i, top[i]]))))
                    sets.append([{"lang": m.languages[k], "share": float(shares[i, k])} for k in np.argsort(-shares[i], kind="stable") if shares[i, k] > 0])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], names=[*kept, "lang_pred", "score", "languages"])

    from pyspark.sql import types as T

    out = T.StructType(list(schema.fields))
    out = out.add("lang_pred", "string").add("score", "double").add("languages", T.ArrayType(T.StructType().add("lang", "string").add("share", "double")))
    return docs.select(*kept).mapInArrow(trimmed(run), out)


def _ascii_letter():
    import re

    return re.compile(rb"[A-Za-z]").search


_LETTER = _ascii_letter()


def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(is_training()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~is_training()).alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))
