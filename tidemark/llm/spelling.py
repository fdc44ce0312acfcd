"""Groups of spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so anagrams share it and one letter more, less or
another changes it by that letter's value, or by the difference of two. Two keys differ by one letter added or removed if one is
the other less a letter's value, and by an exchange if both are alike less one value each. So every word gives its own key
and, for each of its letters, the key less that letter; joins on equal keys find all such pairs. A class of anagrams would still
pair with itself in full, so what the letters' order must be is part of the join: a hash of the word without that letter, and
for exchanges the letter's place. Pairs so found are then compared letter by letter. At one place stand at most 90
different letters, so a key of that kind has at most 90 words, however frequent.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import short_batches, stage, unstage
from tidemark.llm.stretches import spread

#: In Latin-1: letters in lower case (A-Z only), all other bytes a space. Characters beyond Latin-1 become '?' before.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))
#: Distinct words counted in a task before their counts are passed on.
HELD = 300_000
#: A letter's value in a key, and in the hash of letters in order (odd base, and its inverse modulo 2 ** 64).
POWER = np.arange(256, dtype=np.uint64) ** np.uint64(5)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _runs(every: int):
    """Counts of letter runs; every `every`-th (document, run) by checksum loses one letter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.record_batch([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                runs = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for w, n in runs.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % every == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1 :]
                    total[w] += n
                if len(total) >= HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return rows


def vocabulary(docs: DataFrame, every: int = 97, least_letters: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): letter runs of all whole texts that are long and frequent enough, after deletions by checksum.

    Null texts have none; a null doc_id counts as an empty one in the checksum. Counts are added up in each task first."""
    short_batches(docs.sparkSession)
    counts = docs.select("doc_id", "text").mapInArrow(_runs(every), "word string, n long")
    return counts.where(F.length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rest, place, id) of each word: its own (place -1), and without the letter at each place."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        if not words:
            continue
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        first, last = np.cumsum(n) - n, np.cumsum(n)
        place = spread(np.zeros(len(n), np.int64), n)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(int(n.max()), 1), BASE, np.uint64)]))
        value = (letters.astype(np.uint64) + np.uint64(1)) * powers[place]
        sums, weights = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (value, POWER[letters]))
        key, order = weights[last] - weights[first], sums[last] - sums[first]
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(letters))
        rest = (sums[at] - sums[first[of]]) + (sums[last[of]] - sums[at + 1]) * np.uint64(INVERSE)
        again = np.append(False, (letters[1:] == letters[:-1]) & (place[1:] > 0))[: len(letters)]
        columns = [
            np.concatenate([key, key[of] - POWER[letters]]).view(np.int64), np.concatenate([order, rest]).view(np.int64),
            np.concatenate([np.full(len(n), -1), place]).astype(np.int32), np.concatenate([np.zeros(len(n), bool), again]), np.concatenate([ids, ids[of]]),
        ]
        yield pa.record_batch([pa.array(c) for c in columns], names=["key", "rest", "place", "again", "id"])


def _without(word: Column, place: Column) -> Column:
    """A word without the letter at a place (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(id, near_id, near_word, near_n): both directions of all pairs of words(id, word, n) one letter apart, each once."""
    keys = stage(words.select("id", "word").mapInArrow(_keys, "key long, rest long, place int, again boolean, id long"), "keys")
    own = keys.where("place < 0").select("key", "rest", F.col("id").alias("short"))
    less = keys.where("place >= 0")
    # of equal letters in a row any one can go: only the first counts
    gone = less.where("not again").join(own, ["key", "rest"]).select(F.col("id").alias("x"), F.col("short").alias("y"), "place", F.lit(False).alias("same"))
    alike = less.groupBy("key", "rest", "place").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    swapped = alike.select("place", F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y"), "place", F.lit(True).alias("same")).where("x < y")
    pairs = gone.unionByName(swapped)
    a = words.select(F.col("id").alias("x"), F.col("word").alias("xw"), F.col("n").alias("xn"))
    b = words.select(F.col("id").alias("y"), F.col("word").alias("yw"), F.col("n").alias("yn"))
    right = _without(F.col("xw"), F.col("place")) == F.when(F.col("same"), _without(F.col("yw"), F.col("place"))).otherwise(F.col("yw"))
    checked = pairs.join(a, "x").join(b, "y").where(right)
    both = F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("near_id"), F.col("yw").alias("near_word"), F.col("yn").alias("near_n")), F.struct(F.col("y").alias("id"), F.col("x").alias("near_id"), F.col("xw").alias("near_word"), F.col("xn").alias("near_n"))))
    return checked.select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root): the end of each chain of forms(id, form_id). Each round doubles the steps taken; as counts double from
    word to form, 64 steps reach every end."""
    steps = stage(forms.select("id", F.col("form_id").alias("root")), "steps")
    for _ in range(6):
        onward = steps.select(F.col("id").alias("root"), F.col("root").alias("further"))
        nxt = stage(steps.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "steps")
        unstage(steps)
        steps = nxt
        if not steps.where("moved").limit(1).count():
            break
    return steps.select("id", "root")


def group(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n): near words counted; the most frequent (of equal ones the first
    in code-point order) is a word's form if it is `ratio` times as frequent; the root is the end of the chain of forms.

    Words must be letters of Latin-1. An empty table gives no rows."""
    words = stage(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near_word").alias("form"), F.col("near_id").alias("form_id"))).alias("best")
    near = near_pairs(words).groupBy("id").agg(F.count("*").alias("n_near"), best)
    follows = -F.col("best.m") >= ratio * F.col("n")
    known = stage(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(follows, c).alias(a) for c, a in ((F.col("best.form"), "form"), (-F.col("best.m"), "form_n"), (F.col("best.form_id"), "form_id"))]), "forms")
    roots = _roots(known.where("form_id is not null")).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(roots, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """`group` of the `vocabulary` of documents: word, form, root, n, n_near, form_n. Columns besides doc_id and text are not
    read; repeated rows count each."""
    return group(vocabulary(docs))


def oracle(every: int = 97, least_letters: int = 5, least_n: int = 3, ratio: int = 2) -> str:
    """The same in DuckDB SQL, by another way: near words meet in what is left of both without one letter, as text."""
    nibbles = []
    for v in range(16):  # of the reflected polynomial of crc32
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        nibbles.append(v)
    return f"""
with recursive runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents),
low as (select coalesce(cast(doc_id as varchar), '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from runs),
c as (select id, run, count(*) as n, hex(encode(concat(id, ':', run))) as x from low group by id, run),
b as (select run, n, list_transform(range(len(x)), lambda k: cast(instr('0123456789ABCDEF', substr(x, k + 2 - 2 * (k % 2), 1)) - 1 as bigint)) as nibbles from c),
h as (select run, n, xor(list_reduce(list_prepend(4294967295, nibbles), lambda a, v: xor(a >> 4, {nibbles}[(xor(a, v) & 15) + 1])), 4294967295) as h from b),
d as (select case when h % {every} = 0 then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as word, n from h),
w as materialized (select word, cast(sum(n) as bigint) as n from d where length(word) >= {least_letters} group by word having sum(n) >= {least_n}),
l as materialized (select word, i, concat(substr(word, 1, i), substr(word, i + 2)) as rest from (select word, unnest(range(length(word))) as i from w)),
p as (select a.word, b.word as near from l a join l b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select l.word, w.word from l join w on l.rest = w.word union select w.word, l.word from l join w on l.rest = w.word),
q as (select p.word, near, x.n, row_number() over (partition by p.word order by x.n desc, near) as k, count(*) over (partition by p.word) as n_near from p join w x on p.near = x.word),
f as materialized (select w.word, w.n, coalesce(q.n_near, 0) as n_near, case when q.n >= {ratio} * w.n then q.near end as form, case when q.n >= {ratio} * w.n then q.n end as form_n
  from w left join q on w.word = q.word and q.k = 1),
up as (select word, form as at from f where form is not null union all select up.word, f.form from up join f on f.word = up.at where f.form is not null)
select f.word, f.form, coalesce(e.at, f.word) as root, f.n, f.n_near, f.form_n
  from f left join (select up.word, up.at from up join f on f.word = up.at where f.form is null) e on e.word = f.word
"""
