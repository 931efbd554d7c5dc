"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its five-word shingles (words as in ``textbatch``); a line of one to four words
has one, all its words; a line without words has none and always stays. Two lines match if the
Jaccard similarity of their token sets is at least 0.8. A line that matches an earlier one goes, also
if that one goes too. Earlier: smaller id (nulls first), then the text's hash, then line number.

1. A line's words become 8 bytes each, end to end; a token is the 64-bit hash of 40 of these bytes, so two
   tokens of compared lines are taken for one with chance 2**-62.
2. Lines with the same words fold into one with partial aggregates: their first place, however many
   there are. All but the first go. The folded lines are numbered in the order of their places.
3. A line's prefix is its n - ceil(0.8 n) + 1 first tokens: matching lines share one of them. Any fixed
   order of tokens makes that exact. Here it is the hash, but tokens that many lines share come last
   (``frequent``): prefixes are counted in buckets, the tokens of full buckets one by one, and only lines
   with such a token get a new prefix.
4. For each prefix token, lines are first paired with the earliest line that has it, not with one
   another; length and position filters, then what both prefixes share (``close``), then the full sets, decide. Of
   a large group of near copies most are settled by that. More rounds may take the earliest line not settled; what is
   left after ``ROUNDS`` rounds meets all other earlier lines of its tokens. So no match is lost, and a group of
   copies doesn't become pairs.
5. The earliest line of a token comes from a window over the token's lines. A frequent token, of which alone a
   window could grow large, goes another way: a partial minimum, then a join whose hot keys Spark splits. All
   other joins are such joins too.

Rows that agree in id and text are one row repeated and get the same result each. Null texts have no
lines and stay null, with 0 lines; an empty text has one line, which stays. A line of any length is
one array, never cut. An empty table gives an empty table. Other columns, whatever their names, are
kept as they are; where one is called ``n_lines`` or ``n_removed``, the added one is called
``n_lines_2`` or ``n_removed_2``, and so on.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, bound, free, quoted

#: Buckets of the count of prefix tokens, as a power of two, at most.
BUCKETS = 22
ROUNDS = 1
#: A token is frequent in over HOT times the lines a bucket has on average, or LEAST if that is more.
HOT, LEAST = 8, 32
#: Added to a frequent token, and the least of the sums; the others lie below.
LATE, FIRST_LATE = 1 << 62, 1 << 61
#: What ASCII has between words, but for the space and the newline; single characters are one lookup for the regex.
GAPS = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum() and chr(c) not in " \n" or chr(c).isupper()) + "]+"


def plain(text: Column) -> Column:
    """Lower-cased words with spaces between them; newlines stay."""
    return F.regexp_replace(F.lower(text), GAPS, " ")


def hashed(content: Column) -> Column:
    """Eight bytes a word of a plain line. The sign bit is set, so that all have 16 digits."""
    words = F.array_remove(F.split(content, " "), "")
    return F.unhex(F.array_join(F.transform(words, lambda w: F.hex(F.xxhash64(w).bitwiseOR(F.lit(-(1 << 63))))), ""))


def tokens(words: Column, k: int) -> Column:
    """The distinct tokens of a line in ascending order, from its ``hashed`` words (at least one)."""
    last = F.length(words) - 8 * k + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(8)), lambda i: F.xxhash64(F.substr(words, i, F.lit(8 * k))))
    return F.when(last < 1, F.array(F.xxhash64(words))).otherwise(F.sort_array(F.array_distinct(runs)))


def prefix_size(size: Column, up: int, down: int) -> Column:
    return (size - F.ceil(size * F.lit(up) / F.lit(down)) + 1).cast("int")


def printed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col))
    return documents.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"))


def described(documents: DataFrame, id_col: str, text_col: str, k: int, up: int, down: int) -> DataFrame:
    """(doc, print, line, key, key2, size, prefix) of every line that has words."""
    lines = printed(documents, id_col, text_col).select("doc", "print", F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line", "content"))
    words = lines.where(F.trim("content") != "").select("doc", "print", "line", hashed(F.col("content")).alias("words"))
    sets = words.select("doc", "print", "line", F.xxhash64("words").alias("key"), F.xxhash64(F.lit(1), "words").alias("key2"), tokens(F.col("words"), k).alias("tokens"))
    size = F.size("tokens")
    return sets.select("doc", "print", "line", "key", "key2", size.alias("size"), F.transform(F.slice("tokens", F.lit(1), prefix_size(size, up, down)), lambda t: F.shiftright(t, 2)).alias("prefix"))


def token_sets(documents: DataFrame, id_col: str, text_col: str, places: DataFrame, k: int) -> DataFrame:
    """(id, tokens) of the lines at ``places`` (id, doc, print, line), once each."""
    wanted = places.groupBy(F.col("doc").alias("d"), F.col("print").alias("p")).agg(F.collect_list(F.struct("id", "line")).alias("at"))
    there = printed(documents, id_col, text_col).join(wanted, F.col("doc").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")))
    lines = there.select(F.split("text", "\n").alias("lines"), F.explode("at").alias("at")).select("at.id", F.get("lines", F.col("at.line")).alias("content"))
    return lines.select("id", hashed(plain(F.col("content"))).alias("words")).select("id", tokens(F.col("words"), k).alias("tokens"))


def kept_sets(scratch: Scratch, documents: DataFrame, id_col: str, text_col: str, places: DataFrame, k: int) -> DataFrame:
    places = scratch.keep(places)
    sets = scratch.keep(token_sets(documents, id_col, text_col, places, k))
    if sets.count() > places.count():  # of repeated rows
        sets = scratch.keep(sets.dropDuplicates(["id"]))
    scratch.drop(places)
    return sets


def frequent(prefix: DataFrame, scratch: Scratch, buckets: int) -> tuple[DataFrame | None, float]:
    """The tokens that many prefixes have, if there are any, and how many lines count as many.

    A token is counted by itself only where its bucket is full.
    """
    n = prefix.agg(F.sum(F.size("prefix"))).first()[0] or 0
    bits = min(buckets, max(10, (n >> 6).bit_length()))
    limit = HOT * max(n / (1 << bits), LEAST)
    bucket = F.col("token").bitwiseAND(F.lit((1 << bits) - 1)).alias("bucket")
    each = prefix.select(F.explode("prefix").alias("token"))
    full = scratch.keep(each.groupBy(bucket).count().where(F.col("count") > limit).select("bucket"))
    if full.isEmpty():
        return None, limit
    found = scratch.keep(each.withColumn("bucket", bucket).join(full, "bucket").groupBy("token").count().where(F.col("count") > limit).select("token"))
    return (None if found.isEmpty() else found), limit


def frequent_last(prefix: DataFrame, folded: DataFrame, sets_of: Callable[[DataFrame], DataFrame], scratch: Scratch, buckets: int, up: int, down: int) -> DataFrame:
    """The prefixes (id, size, prefix) for an order with frequent tokens last; these have ``LATE`` added."""
    late, limit = frequent(prefix, scratch, buckets)
    if late is None:
        return prefix
    having = lambda some: prefix.select("id", F.explode("prefix").alias("token")).join(some, "token").select("id").distinct()
    each = lambda sets: sets.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("t")).select("id", "size", F.shiftright("t", 2).alias("token"))
    # lines that share such a token often share others, which would follow it into the prefix
    known = scratch.keep(having(late))
    sets = sets_of(folded.join(known, "id"))
    more = each(sets).groupBy("token").count().where(F.col("count") > limit).select("token")
    late = scratch.keep(late.unionByName(more).distinct())
    changed = scratch.keep(having(late))
    rest = sets_of(folded.join(changed, "id").join(known, "id", "left_anti"))
    marked = each(sets.unionByName(rest)).join(late.withColumn("late", F.lit(LATE)), "token", "left")
    order = marked.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.col("token") + F.coalesce("late", F.lit(0)))).alias("all"))
    new = order.select("id", "size", F.slice("all", F.lit(1), prefix_size(F.col("size"), up, down)).alias("prefix"))
    out = scratch.keep(prefix.join(changed, "id", "left_anti").unionByName(new))
    scratch.drop(prefix, known, changed, sets, rest)
    return out


def with_pivots(each: DataFrame) -> DataFrame:
    """(token, id, size, pos, other, osize, opos) of the rows (token, id, size, pos) whose token an earlier line has; ``other`` is the earliest."""
    own = ["token", "id", "size", "pos"]
    w = Window.partitionBy("token").orderBy("id")
    cold = each.where(F.col("token") < FIRST_LATE).select(*own, *[F.first(c).over(w).alias(o) for c, o in (("id", "other"), ("size", "osize"), ("pos", "opos"))])
    hot = each.where(F.col("token") >= FIRST_LATE).select(*own)
    pivot = hot.groupBy("token").agg(F.min("id").alias("other"), F.max("id").alias("last")).where("other <> last").select("token", "other")
    met = hot.join(pivot, "token")
    place = met.where("id = other").select("token", F.col("size").alias("osize"), F.col("pos").alias("opos")).dropDuplicates(["token"])
    return cold.where("id <> other").unionByName(met.where("id <> other").join(place, "token"))


def at_place(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` at the places (id, doc, print, line), with their ids."""
    p = places.select("id", F.col("doc").alias("d"), F.col("print").alias("p"), F.col("line").alias("l"))
    return rows.join(p, F.col("doc").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")) & (F.col("line") == F.col("l"))).select("id", *[c for c in rows.columns if c not in ("doc", "print", "line")])


def meets(up: int, down: int) -> Column:
    """Whether two lines that share a token can match: by their lengths, and by the tokens from the shared one on."""
    least = F.ceil((F.col("size") + F.col("osize")) * F.lit(up) / F.lit(up + down))
    lengths = (F.col("size") * down >= F.col("osize") * up) & (F.col("osize") * down >= F.col("size") * up)
    return lengths & (F.least(F.col("size") - F.col("pos"), F.col("osize") - F.col("opos")) >= least)


def others(member: DataFrame) -> DataFrame:
    return member.select("token", F.col("id").alias("other"), F.col("size").alias("osize"), F.col("pos").alias("opos"))


def close(pairs: DataFrame, prefix: DataFrame, up: int, down: int) -> DataFrame:
    """The ``pairs`` (id, other) that may be similar by their prefixes: what isn't in both lies beyond the prefix that ends first."""
    one = prefix.select("id", F.col("size").alias("n"), F.col("prefix").alias("a"))
    two = prefix.select(F.col("id").alias("other"), F.col("size").alias("m"), F.col("prefix").alias("b"))
    rest = F.when(F.element_at("a", -1) <= F.element_at("b", -1), F.col("n") - F.size("a")).otherwise(F.col("m") - F.size("b"))
    most = F.size(F.array_intersect("a", "b")) + rest
    return pairs.join(one, "id").join(two, "other").where(most * (up + down) >= F.lit(up) * (F.col("n") + F.col("m"))).select("id", "other")


def similar(pairs: DataFrame, sets: DataFrame, up: int, down: int) -> DataFrame:
    """The ids of ``pairs`` (id, other) whose token sets are similar."""
    one = sets.select("id", F.col("tokens").alias("a"))
    two = sets.select(F.col("id").alias("other"), F.col("tokens").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.join(one, "id").join(two, "other").where(shared * (up + down) >= F.lit(up) * (F.size("a") + F.size("b"))).select("id").distinct()


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (4, 5), shingle: int = 5, buckets: int = BUCKETS, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` with repeated lines taken out of the text, plus ``n_lines`` and ``n_removed``.

    threshold: the similarity as numerator and denominator.
    """
    up, down = threshold
    scratch = Scratch(documents.sparkSession, "line-dedup")
    sets_of = functools.partial(kept_sets, scratch, documents, id_col, text_col, k=shingle)
    lines = scratch.keep(described(documents, id_col, text_col, shingle, up, down))
    place = F.struct("doc", "print", "line")
    folded = lines.groupBy("key", "key2").agg(F.min(place).alias("first"), F.count("*").alias("n")).orderBy("first")
    folded = scratch.keep(folded.select(F.monotonically_increasing_id().alias("id"), "key", "key2", "first.*", "n"))  # fixed by being written
    prefix = scratch.keep(at_place(lines.select("doc", "print", "line", "size", "prefix"), folded))
    if prefix.count() > folded.count():  # of repeated rows
        prefix = scratch.keep(prefix.dropDuplicates(["id"]))
    keys = scratch.keep(lines.select("doc", "print", "line", "key", "key2"))
    scratch.drop(lines)
    prefix = frequent_last(prefix, folded.select("id", "doc", "print", "line"), sets_of, scratch, buckets, up, down)
    rows = scratch.keep(with_pivots(prefix.select("id", "size", F.posexplode("prefix").alias("pos", "token"))))

    def settle(pairs: DataFrame) -> DataFrame:
        """The ids of ``pairs`` that go; only lines of pairs that can match by their prefixes get their full sets."""
        pairs = scratch.keep(close(pairs.select("id", "other").distinct(), prefix, up, down))
        wanted = pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct()
        sets = sets_of(folded.select("id", "doc", "print", "line").join(wanted, "id"))
        out = scratch.keep(similar(pairs, sets, up, down))
        scratch.drop(pairs, sets)
        return out

    member = rows.select("token", "id", "size", "pos").distinct()
    settled, left = [settle(rows.where(meets(up, down)))], member
    for _ in range(rounds - 1):  # a pivot isn't settled: it goes on to the last step as the later line, but is a pivot once
        left = left.join(settled[-1], "id", "left_anti")
        pivot = left.groupBy("token").agg(F.min("id").alias("other"))
        pairs = left.join(pivot.join(others(left), ["token", "other"]), "token").where("id <> other").where(meets(up, down))
        settled.append(settle(pairs))
        left = scratch.keep(left.join(pivot.withColumnRenamed("other", "id"), ["token", "id"], "left_anti"))
    near = functools.reduce(DataFrame.unionByName, settled).distinct()
    # what no pivot settled meets every other earlier line of its tokens
    late = member.join(near, "id", "left_anti")
    scratch.drop()
    settled.append(settle(late.join(others(member), "token").where("id > other").where(meets(up, down))))
    scratch.drop(prefix, rows, left)
    done = functools.reduce(DataFrame.unionByName, settled).distinct()

    # all places of a settled line go, and of other lines all but the first
    gone = folded.join(done.withColumn("settled", F.lit(True)), "id", "left").where("n > 1 or settled")
    gone = gone.select("key", "key2", F.struct("doc", "print", "line").alias("first"), F.coalesce("settled", F.lit(False)).alias("settled"))
    out = keys.join(gone, ["key", "key2"]).where(F.col("settled") | (place != F.col("first")))
    out = scratch.keep(out.groupBy("doc", "print").agg(F.collect_set("line").alias("gone")))
    scratch.drop(folded, keys, *settled)
    return without(documents, out, id_col, text_col)


def without(documents: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``documents`` without the lines in ``gone`` (doc, print, gone: their numbers)."""
    taken = documents.columns
    n_lines, n_removed = free("n_lines", taken), free("n_removed", taken)
    mark, doc, print_, lost = (free(n, [*taken, n_lines, n_removed]) for n in ("mark", "doc", "print", "gone"))
    text, out = F.col(quoted(text_col)), gone.select(F.col("doc").alias(doc), F.col("print").alias(print_), F.col("gone").alias(lost))
    marked = documents.withColumn(mark, F.xxhash64(text))
    joined = marked.join(out, (F.col(mark) == F.col(print_)) & F.col(quoted(id_col)).eqNullSafe(F.col(doc)), "left")
    split = F.split(text, "\n", -1)
    kept = bound(split, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col(lost)), lambda i: F.get(s, i)), "\n"))
    new = F.when(F.col(lost).isNull(), text).otherwise(kept)
    return joined.select(*[new.alias(c) if c == text_col else F.col(quoted(c)) for c in taken], F.coalesce(F.size(split), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(n_removed))
