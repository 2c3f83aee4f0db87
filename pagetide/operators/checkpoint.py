"""Content-addressed checkpoints of a table of files: manifests, objects, reuse, restore, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE_BYTES = 1024
CHUNK_BYTES = 12_288
KEEP = 3
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 2000, 64 << 20, 256 << 20


def files(rows: DataFrame) -> DataFrame:
    """rows(path, content) -> path, size, sha256, content."""
    return rows.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def pack(state: DataFrame, generation: int, previous: DataFrame | None = None, pinned: str = "snapshots/") -> tuple[DataFrame, DataFrame]:
    """(manifest, new objects): small files inline, others by digest; objects that the previous manifest names are not written again."""
    inline = (F.col("size") <= INLINE_BYTES) & ~F.col("path").startswith(pinned)
    manifest = state.select(F.lit(generation).cast("long").alias("generation"), "path", "size", "sha256", F.when(inline, F.col("content")).alias("inline_text"))
    objects = state.where(~inline).select("sha256", "size", "content").dropDuplicates(["sha256", "size"])
    if previous is not None:
        objects = objects.join(previous.where("inline_text IS NULL").select("sha256", "size"), ["sha256", "size"], "left_anti")
    return manifest, objects


def restore(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, content, intact): contents from manifest and objects, size and digest computed anew."""
    full = manifest.join(objects.select("sha256", "size", F.col("content").alias("object")), ["sha256", "size"], "left")
    content = F.coalesce("inline_text", "object")
    intact = F.coalesce((F.sha2(content, 256) == F.col("sha256")) & (F.octet_length(content) == F.col("size")), F.lit(False))
    return full.select("path", content.alias("content"), intact.alias("intact"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of two manifests: added, removed, modified."""
    b = before.select("path", F.col("size").alias("old_size"), F.col("sha256").alias("old_sha256"))
    both = now.select("path", "size", "sha256").join(b, "path", "full_outer")
    change = F.when(F.col("old_sha256").isNull(), "added").when(F.col("sha256").isNull(), "removed").when((F.col("sha256") != F.col("old_sha256")) | (F.col("size") != F.col("old_size")), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def object_reuse(manifests: DataFrame) -> DataFrame:
    """manifests of all generations -> (generation, sha256, size, reused): whether an older generation holds the object."""
    objects = manifests.where("inline_text IS NULL").select("generation", "sha256", "size").distinct()
    first = objects.groupBy("sha256", "size").agg(F.min("generation").alias("first"))
    return objects.join(first, ["sha256", "size"]).select("generation", "sha256", "size", (F.col("first") < F.col("generation")).alias("reused"))


def chunks(objects: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(sha256, chunk, bytes, chunk_sha256, next_sha256): fixed-size pieces, each with the digest of the one behind it. Row-local: no window."""
    raw = F.encode("content", "UTF-8")
    count = F.greatest(F.ceil(F.octet_length("content") / size).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))
    made = objects.select("sha256", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.struct(F.length(F.get(pieces, i - 1)).alias("b"), F.sha2(F.get(pieces, i - 1), 256).alias("s"), F.sha2(F.get(pieces, i), 256).alias("n")))).alias("chunk", "p"))
    return made.select("sha256", "chunk", F.col("p.b").alias("bytes"), F.col("p.s").alias("chunk_sha256"), F.col("p.n").alias("next_sha256"))


def linked_chunks(objects: DataFrame, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """objects(sha256, size, content) -> (heads(sha256, size, chunks, head), pieces(id, index, data, next)): contents in pieces of `size` bytes.

    A piece's id is the hash of its index, data and the id behind it, so that a head vouches for its whole chain. Equal ends of
    equal offset are one piece. Row-local: the chain of a content is folded from its end.
    """
    raw = F.encode("content", "UTF-8")
    count = F.greatest(F.ceil(F.octet_length("content") / size).cast("int"), F.lit(1))
    steps = F.reverse(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("index"), F.substring(raw, i * size + 1, F.lit(size)).alias("data"))))
    kind = "array<struct<id:string,index:int,data:binary,next:string>>"

    def link(done: Column, x: Column) -> Column:
        behind = F.get(done, F.size(done) - 1)["id"]
        return F.array_append(done, F.struct(piece_id(x["index"], x["data"], behind).alias("id"), x["index"].alias("index"), x["data"].alias("data"), behind.alias("next")))

    made = objects.select("sha256", "size", F.aggregate(steps, F.array().cast(kind), link).alias("p"))
    heads = made.select("sha256", "size", F.size("p").alias("chunks"), F.get("p", F.size("p") - 1)["id"].alias("head"))
    return heads, made.select(F.explode("p").alias("p")).select("p.*").dropDuplicates(["id"])


def piece_id(index: Column, data: Column, behind: Column) -> Column:
    return F.sha2(F.concat_ws(":", index.cast("string"), F.coalesce(behind, F.lit("end")), F.sha2(data, 256)), 256)


def reassembled(heads: DataFrame, pieces: DataFrame) -> DataFrame:
    """heads(sha256, size, chunks, head), pieces(id, index, data, next) -> (sha256, content, problem).

    Chains are walked by doubling: round k joins each place found so far with the piece 2^k further on, so that rounds grow with the
    logarithm of the longest chain, as its head states it. Data joins last. problem: `missing piece`, `broken link` (a hash or an
    index doesn't fit, which is how a cycle shows), `extra piece` behind the last, `wrong content`; content is null then.
    """
    longest = heads.agg(F.max("chunks")).first()[0] or 0
    jump = pieces.select("id", F.col("next").alias("to"))
    reached = heads.select("sha256", "chunks", F.lit(0).alias("place"), F.col("head").alias("id"))
    step = 1
    while step < longest:
        ahead = reached.join(jump, "id").select("sha256", "chunks", (F.col("place") + step).alias("place"), F.col("to").alias("id")).where("place < chunks")
        reached = reached.union(ahead.where("id IS NOT NULL"))
        jump = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")).where("to IS NOT NULL")
        step *= 2
    found = reached.join(pieces, "id", "left")
    sound = F.col("index").isNull() | ((F.col("index") == F.col("place")) & (piece_id(F.col("index"), F.col("data"), F.col("next")) == F.col("id")))
    part = F.struct("place", "data")
    whole = found.groupBy("sha256").agg(
        F.count("index").alias("n"), F.bool_and(sound).alias("sound"), F.bool_or((F.col("place") == F.col("chunks") - 1) & F.col("next").isNotNull()).alias("extra"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    joined = heads.select("sha256", "size", "chunks").join(whole, "sha256", "left").withColumn("bytes", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"])))
    problem = F.when(~F.col("sound"), "broken link").when(F.coalesce("n", F.lit(0)) != F.col("chunks"), "missing piece").when(F.col("extra"), "extra piece").when((F.sha2("bytes", 256) != F.col("sha256")) | (F.octet_length("bytes") != F.col("size")), "wrong content")
    return joined.select("sha256", F.when(problem.isNull(), F.decode("bytes", "UTF-8")).alias("content"), problem.alias("problem"))


def totals(manifest: DataFrame) -> DataFrame:
    """(generation, files, bytes, largest, within_limits)."""
    sums = manifest.groupBy("generation").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return sums.withColumn("within_limits", (F.col("files") <= MAX_FILES) & (F.col("largest") <= MAX_FILE_BYTES) & (F.col("bytes") <= MAX_TOTAL_BYTES))


def retention(manifests: DataFrame, keep: int = KEEP) -> DataFrame:
    """(kind, id, action): manifests and objects to keep and to delete; an object that a kept manifest names stays."""
    generations = manifests.select("generation").distinct()
    newest = generations.orderBy(F.desc("generation")).limit(keep)
    kept = manifests.join(F.broadcast(newest), "generation", "left_semi")
    gone = manifests.join(F.broadcast(newest), "generation", "left_anti")
    ids = lambda m: m.select(F.lit("manifest").alias("kind"), F.col("generation").cast("string").alias("id")).union(m.where("inline_text IS NULL").select(F.lit("object"), "sha256")).distinct()
    return ids(kept).withColumn("action", F.lit("keep")).union(ids(gone).subtract(ids(kept)).withColumn("action", F.lit("delete")))


def next_generation(names: DataFrame, now: str) -> DataFrame:
    """names(generation stamp) -> (active, next): the newest stamp, and now or a second after it, whichever is later."""
    ts = F.try_to_timestamp("generation", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    top = names.agg(F.max_by("generation", ts).alias("active"), F.max(ts).alias("newest"))
    current = F.to_timestamp(F.lit(now), "yyyyMMdd'T'HHmmss'Z'")
    return top.select("active", F.date_format(F.greatest(current, F.col("newest") + F.expr("INTERVAL 1 SECOND")), "yyyyMMdd'T'HHmmss'Z'").alias("next"))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(path, problem): unsafe paths, repeated paths, paths that are folders of others, control characters in inline text."""
    unsafe = ~F.col("path").rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*(?:/[A-Za-z0-9_][A-Za-z0-9_.-]*)*$")
    control = F.coalesce(F.col("inline_text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit(False))
    rows = manifest.select("path", F.explode(F.array_compact(F.array(F.when(unsafe, "unsafe"), F.when(control, "control characters")))).alias("problem"))
    repeated = manifest.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("repeated").alias("problem"))
    parts = F.split("path", "/")
    folders = manifest.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("folder"), "path").where("folder <> path").select("folder").distinct()
    clash = manifest.join(folders, F.col("path") == F.col("folder"), "left_semi").select("path", F.lit("is a folder").alias("problem"))
    return rows.union(repeated).union(clash).distinct()


def receipt_coverage(objects: DataFrame, receipts: DataFrame) -> DataFrame:
    """(sha256, verdict) of objects without a receipt and receipts without an object; empty if they cover each other."""
    o, r = objects.select("sha256").distinct(), receipts.select("sha256").distinct()
    return o.join(r, "sha256", "left_anti").withColumn("verdict", F.lit("no receipt")).union(r.join(o, "sha256", "left_anti").withColumn("verdict", F.lit("no object")))


