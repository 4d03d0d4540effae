"""Game-record text files and text columns to games, rejects and plies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import gametext as G
from turnwise.functions import moves as M
from turnwise.operators.ordering import HOT_ROWS, null_safe_join, number_rows, running_totals
from turnwise.schemas import CATEGORIES
from turnwise.session import materialise

#: Records start at the Event tag; the separator eats this prefix of all but the first.
_EVENT = "[Event "
SEPARATOR = "\n" + _EVENT
#: Bytes of a byte order mark.
_MARK = 3

#: Games per piece when the game numbers of a hot file are counted.
INDEX_RUN = 100_000

#: Within a record, a tag line after a line of moves opens another game.
_NEXT_GAME = r'(?m)(^(?![ \t]*(?:\[|$))[^\n]*\n(?:[ \t\r]*\n)*)(?=\[[A-Za-z0-9_]+[ \t]+")'
_CUT = "\x1e"

HEADER_TAGS = {
    "event": "Event", "site": "Site", "date": "Date", "round": "Round", "white_player": "White",
    "black_player": "Black", "white_elo": "WhiteElo", "black_elo": "BlackElo", "result": "Result",
}


def scan_pieces(spark: SparkSession, path: str, *, glob: str = "*.[pP][gG][nN]", tolerant: bool = False) -> DataFrame:
    """Records of all files below ``path``, not numbered yet; one read, no shuffle.

    Columns file, __block, __at, __piece (their order), record, __bytes, __size. A blank stretch of a
    file is a row with a NULL record, so that the __bytes of a file add up to what was read of it.
    ``tolerant`` goes on behind a file that breaks off or is gone; ``unread_files`` finds those.
    A file without the right to read it ends the job either way.
    """
    raw = (
        spark.read.option("lineSep", SEPARATOR)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", tolerant)
        .option("ignoreMissingFiles", tolerant)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__at"),
            F.col("_metadata.file_size").alias("__size"),
            F.col("value"),
        )
    )
    text = F.regexp_replace("value", "^\ufeff", "")
    # what follows an eaten prefix is the quoted event name
    record = F.when(text.rlike(r'^\s*"'), F.concat(F.lit(_EVENT), text)).otherwise(text)
    blank = F.array(F.lit(None).cast("string"))
    cut = raw.select(
        "file", "__block", "__at", "__size", (F.octet_length("value") + len(SEPARATOR)).alias("__taken"),
        F.posexplode(F.when(F.col("value").rlike(r"\S"), split_games(record)).otherwise(blank)).alias("__piece", "record"),
    )
    taken = F.when(F.col("__piece") == 0, F.col("__taken")).otherwise(0).cast("bigint")
    return cut.select("file", "__block", "__at", "__piece", "record", taken.alias("__bytes"), "__size")


def number_games(pieces: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds game_index, from 1 per file in the order of the file, and drops the columns of the scan."""
    numbered = number_rows(
        pieces, ["file"], ["__block", "__at", "__piece"], "game_index",
        spread=F.struct("__block", F.shiftright("__at", 16)), hot_rows=hot_rows,
    )
    return numbered.withColumn("game_index", F.col("game_index").cast("int")).drop(
        "__block", "__at", "__piece", "__bytes", "__size")


def scan_records(spark: SparkSession, path: str, *, glob: str = "*.[pP][gG][nN]",
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Records of all files below ``path``: file, game_index (from 1 per file), record.

    Files stay splittable: the separator between records is the line end before an Event
    tag. A record is cut again, row by row, where a tag line follows moves, so games without
    that tag stay apart. Bytes that are not UTF-8 are replaced. An unreadable file ends the job.
    """
    pieces = scan_pieces(spark, path, glob=glob).filter(F.col("record").isNotNull())
    return number_games(pieces, hot_rows=hot_rows).select("file", "game_index", "record")


def scan_category_pieces(spark: SparkSession, root: str, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """``scan_pieces`` of the allow-listed category folders, going on behind broken files."""
    pieces = scan_pieces(spark, _category_glob(root, categories), tolerant=True)
    return pieces.select("*", *_relative("file"))


def unread_files(pieces: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files of which something wasn't read: source_file, source_category.

    Separators are eaten, so a whole file gives its size, and the length of one separator more unless
    it ends with one. A byte order mark is eaten as well; no game is that short.
    """
    read = pieces.groupBy("source_file", "source_category").agg(
        F.sum("__bytes").alias("__read"), F.max("__size").alias("__scanned"))
    known = listed.select("source_file", "source_category", F.col("size").alias("__listed"))
    both = known.join(read, ["source_file", "source_category"], "full")
    missing = F.coalesce("__scanned", "__listed") - F.coalesce("__read", F.lit(0))
    return both.filter(missing > F.when(F.col("__read").isNull(), 0).otherwise(_MARK)).select("source_file", "source_category")


def split_games(record: Column) -> Column:
    """The games of a record: one text per block of tag lines and the moves after it."""
    return F.split(F.regexp_replace(record, _NEXT_GAME, f"$1{_CUT}"), _CUT)


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Add headers, main line, moves and reject reason; row-local.

    The results pass through a generator of one row. Without it the optimizer would push
    a filter on the reject reason below the parsing and repeat the clean-up inside it.
    """
    lines = records.withColumn("__line", G.mainline(column)).withColumn("__moves", G.moves("__line"))
    parsed = F.struct(
        F.col("__line").alias("mainline"),
        F.col("__moves").alias("moves"),
        G.reject_reason(column, "__line", "__moves").alias("reject_reason"),
    )
    return lines.select(*records.columns, F.inline(F.array(parsed))).withColumn("headers", G.headers(column))


def good_games(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull())


def rejects(parsed: DataFrame, keys: Sequence[str] = ("file", "game_index")) -> DataFrame:
    """Rejected records with reason and player names."""
    return parsed.filter(F.col("reject_reason").isNotNull()).select(
        *keys,
        F.col("reject_reason").alias("error"),
        F.element_at("headers", F.lit("White")).alias("white"),
        F.element_at("headers", F.lit("Black")).alias("black"),
    )


def first_games(parsed: DataFrame, *, strict: bool = False) -> DataFrame:
    """The first record of each file; ``strict`` raises on a reject instead of dropping it."""
    first = parsed.filter(F.col("game_index") == 1)
    if not strict:
        return good_games(first)
    return first.withColumn(
        "mainline",
        F.when(F.col("reject_reason").isNull(), F.col("mainline")).otherwise(
            F.raise_error(F.concat(F.col("file"), F.lit(": "), F.col("reject_reason")))
        ),
    )


def require_records(parsed: DataFrame) -> DataFrame:
    """Raise if there is neither a game nor a reject."""
    if parsed.isEmpty():
        raise ValueError("no parseable game found")
    return parsed


def cut_games(games: DataFrame, plies: int, name: str) -> DataFrame:
    """Games in stretches of so many plies at most, numbered from 0 in column ``name``; ``moves`` holds those of the stretch."""
    last = F.greatest(F.size("moves") - 1, F.lit(0))
    runs = games.withColumn(name, F.explode(F.sequence(F.lit(0), F.floor(last / plies).cast("int"))))
    return runs.withColumn("moves", F.slice("moves", F.col(name) * plies + 1, plies))


def explode_plies(games: DataFrame, keys: Sequence[str] = ("file", "game_index"), *, ahead: Column | int = 0) -> DataFrame:
    """One row per main-line half-move with header context and the mover's view; ``ahead`` plies of the game come earlier.

    Side to move and move number come from a FEN header if there is one. Legal-move
    counts, UCI and position are not derivable from the text without a rules engine;
    they join from the engine side.
    """
    fen = F.element_at("headers", F.lit("FEN"))
    tags = [G.header("headers", tag).alias(name) for name, tag in HEADER_TAGS.items()]
    rows = games.select(
        *keys, *tags, fen.alias("__fen"), F.posexplode("moves").alias("__at", "__move")
    ).withColumn("__pos", F.col("__at") + (F.lit(ahead) if isinstance(ahead, int) else ahead))
    black_start = F.coalesce(M.color_from_fen("__fen") == "Black", F.lit(False)).cast("int")
    turn = F.col("__pos") + black_start
    color = F.when(turn % 2 == 0, "White").otherwise("Black")
    start = F.coalesce(M.fullmove_from_fen("__fen"), F.lit(1))
    out = rows.select(
        *keys, *HEADER_TAGS, (F.col("__pos") + 1).alias("ply_number"),
        (start + F.floor(turn / 2)).cast("int").alias("fullmove_number"),
        color.alias("player_color"), F.col("__move.san").alias("san"),
        G.clock_seconds(F.nullif("__move.clock", F.lit(""))).alias("clock_seconds"),
    )
    return with_perspective(out).select("*", *[c.alias(n) for n, c in M.san_flags("san").items()])


def with_perspective(df: DataFrame) -> DataFrame:
    """Name and rating of the mover and of the opponent."""
    return df.select(
        "*",
        M.by_color("player_color", "white_player", "black_player").alias("player_name"),
        M.by_color("player_color", "white_elo", "black_elo").alias("player_elo"),
        M.by_color("player_color", "black_player", "white_player").alias("opponent_name"),
        M.by_color("player_color", "black_elo", "white_elo").alias("opponent_elo"),
    )


def scan_categories(spark: SparkSession, root: str, categories: Sequence[str] = CATEGORIES,
                    *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Records below the allow-listed category folders of ``root``.

    Adds source_category and source_file, the path relative to ``root``.
    """
    records = scan_records(spark, _category_glob(root, categories), hot_rows=hot_rows)
    return records.select("*", *_relative("file"))


def list_categories(spark: SparkSession, root: str, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Every game file below the category folders with its size, also empty ones. Reads no content.

    The file system lists them, as it does for any scan; Spark's own sources leave out empty files.
    """
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(_category_glob(root, categories))
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(f.getPath().toUri().getRawPath(), f.getLen()) for f in files.globStatus(pattern) or []]
    return spark.createDataFrame(found, "path string, size bigint").select(*_relative("path"), "size")


def _category_glob(root: str, categories: Sequence[str]) -> str:
    return f"{root}/{{{','.join(categories)}}}/*.[pP][gG][nN]"


def _relative(path: str) -> list[Column]:
    """Columns source_file and source_category of an encoded file path."""
    tail = F.regexp_extract(path, r"([^/]+/[^/]+)$", 1)
    name = F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B")))
    return [name.alias("source_file"), F.split_part(name, F.lit("/"), F.lit(1)).alias("source_category")]


def with_game_ids(games: DataFrame, categories: Sequence[str] = CATEGORIES, *,
                  category: str = "source_category", file: str = "source_file",
                  order: Sequence[str] = ("game_index",), spread: Column | str | None = None,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number games from 1 over (category order, file name, order within the file).

    Games are numbered inside their file; files get the running total of the games in
    earlier files. Both steps split hot keys, and the second one sees one row per file.
    A hot file is cut by ``spread``, by default into runs of game indexes.
    """
    if spread is None:
        spread = F.floor(F.col(order[0]) / INDEX_RUN)
    inside = number_rows(games, [category, file], list(order), "__inside", spread=spread, hot_rows=hot_rows)
    return add_file_offsets(inside, categories, category=category, file=file)


def add_file_offsets(numbered: DataFrame, categories: Sequence[str], *, category: str, file: str) -> DataFrame:
    """Adds the games of earlier files; categories that aren't listed come last.

    The table of files is sorted into ranges and written, so that a range is a stable bucket of
    the running total, however the files are named.
    """
    place = F.lit(len(categories))
    for i, name in reversed(list(enumerate(categories))):
        place = F.when(F.col(category) == name, i).otherwise(place)
    per_file = numbered.groupBy(category, file).agg(F.count(F.lit(1)).alias("__games")).select(
        "*", place.alias("__place"), F.regexp_extract(F.col(file), "([^/]+)$", 1).alias("__name")
    )
    order = ["__place", "__name", file]
    ranged = materialise(per_file.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "files")
    offsets = running_totals(ranged, [], order, F.col("__range"), {"__upto": "__games"}).select(
        category, file, (F.col("__upto") - F.col("__games")).alias("__offset")
    )
    columns = [c for c in numbered.columns if c != "__inside"]
    return null_safe_join(numbered, offsets, [category, file]).select(
        (F.col("__offset") + F.col("__inside")).alias("game_id"), *columns
    )


def first_n_per_file(games: DataFrame, n: int, *, file: str = "source_file", order: str = "game_index",
                     place: str | None = None) -> DataFrame:
    """At most ``n`` games per file, in file order. The rank limit also runs before the shuffle.

    ``place`` names a column to keep the rank in.
    """
    rank = F.row_number().over(Window.partitionBy(file).orderBy(order))
    few = games.withColumn("__rank", rank).filter(F.col("__rank") <= n)
    return few.withColumnRenamed("__rank", place) if place else few.drop("__rank")


def write_files(games: DataFrame, root: str, *, order: str) -> None:
    """Write texts as game files ``root/category/name.pgn``; a file's games come in the given order.

    Takes columns category, name, value. Each file is one task's work, as a file must be.
    """
    spark = games.sparkSession
    jvm = spark.sparkContext._jvm
    parts = f"{root}/parts"
    placed = games.repartition("category", "name").sortWithinPartitions("category", "name", order)
    placed.select("category", "name", "value").write.partitionBy("category", "name").option("lineSep", "\n").text(parts)
    top = jvm.org.apache.hadoop.fs.Path(parts)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{parts}/category=*/name=*/part-*")):
        part = found.getPath()
        name, category = part.getParent().getName(), part.getParent().getParent().getName()
        goal = jvm.org.apache.hadoop.fs.Path(f"{root}/{category.partition('=')[2]}/{name.partition('=')[2]}.pgn")
        files.mkdirs(goal.getParent())
        files.rename(part, goal)


def render_text(plies: DataFrame, keys: Sequence[str], token: Column, tags: dict[str, Column],
                order: str = "ply_number") -> DataFrame:
    """Game-record text per key from plies; the inverse of parsing.

    ``token`` is the text of one ply. The plies of a key meet in one row, as they do in
    a record, so the keys must bound them.
    """
    body = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), token.alias("token"))))
    rows = plies.groupBy(*keys).agg(body.alias("__body"), *[F.first(c).alias(f"__{t}") for t, c in tags.items()])
    lines = [F.concat(F.lit(f'[{t} "'), F.col(f"__{t}"), F.lit('"]\n')) for t in tags]
    text = F.concat(*lines, F.lit("\n"), F.array_join(F.col("__body.token"), " "))
    return rows.select(*keys, text.alias("record"))
