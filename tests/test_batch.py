"""Folders to tables, sinks and prediction end to end."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_gametext import BARE, MINIMAL, NO_MOVES, TWO
from turnwise import session
from turnwise.learn import models
from turnwise.operators import enrich
from turnwise.plans import batch, eda, prediction, training
from turnwise.schemas import BASE_FEATURES, BENCHMARK_PLIES, MOVE_COLUMNS, PROFILE_COLUMNS
from turnwise.sources import adapters, games, sinks, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name, text in {
        "human_games/opera_game_1858.pgn": TWO, "unlabeled/a.pgn": MINIMAL + "\n" + NO_MOVES, "unlabeled/b.pgn": BARE,
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "unlabeled" / "blank.pgn").write_text(" \n\n")
    return str(root)


def _document(path):
    parts = [p for p in Path(path).glob("part-*") if p.stat().st_size]
    return [json.loads(line) for p in parts for line in p.read_text().splitlines()]


def test_batch_without_engine(spark, root, tmp_path):
    result = batch.run(spark, root)
    assert result.moves.count() == 7 + 4 + 10 + 6 and result.profiles.count() == 8
    bad = {r.source_file: (r.error, r.game_index, r.white) for r in result.rejects.collect()}
    assert bad == {
        "unlabeled/a.pgn": ("no mainline moves", 2, "A"), "unlabeled/blank.pgn": (batch.NO_RECORDS, None, None),
    }
    out = str(tmp_path / "out")
    batch.write(result, out)
    (manifest,) = _document(f"{out}/dataset_manifest")
    summary = manifest["summary"]
    assert (summary["total_files_scanned"], summary["total_games_processed"], summary["total_moves_extracted"]) == (4, 4, 27)
    assert manifest["engine_info"] == {"enabled": False, "engine_name": None, "depth": None}
    assert summary["total_player_games"] == 8
    assert summary["categories"]["human_games"] == {"files": 1, "games": 2, "moves": 11}
    assert summary["categories"]["engine_generated_games"] == {"files": 0, "games": 0, "moves": 0}
    assert manifest["provenance_audit_summary"]["verified_historical_games"] == 1
    moves = tables.move_table(spark, f"{out}/move_level_features")
    assert moves.columns == MOVE_COLUMNS and moves.count() == 27
    row = moves.filter("source_file = 'unlabeled/a.pgn' and ply_number = 2").first()
    assert (row.game_id, row.san, row.player_name, row.white_elo, row.centipawn_loss, row.is_engine_eval_missing) == (3, "e5", "Two", "1500", None, 1)
    profiles = tables.profile_table(spark, f"{out}/player_game_features")
    assert profiles.columns == PROFILE_COLUMNS
    white = profiles.filter("game_id = 1 and player_color = 'White'").first()
    assert (white.player_result, white.total_moves, white.missing_eval_rate, white.checks_count) == ("win", 4, 1.0, 1)
    assert len(_document(f"{out}/files_processed")) == 3


def test_batch_limits_games_and_joins_lines(spark, root):
    plies = batch.run(spark, root, max_games_per_file=1)
    assert plies.moves.select("game_id").distinct().count() == 3
    lines = spark.createDataFrame(
        [("unlabeled/b.pgn", 1, 1, side, 10, 1, uci, san, cp) for side, uci, san, cp in
         (("before", "d2d4", "d4", 30), ("after", None, None, 20))],
        "source_file string, game_index int, ply_number int, side string, depth int, pv_rank int, uci string, san string, cp int",
    ).withColumn("mate", F.lit(None).cast("int"))
    positions = spark.createDataFrame([("unlabeled/b.pgn", 1, 1, "d2d4", "startpos", 20, "Opening")],
                                      "source_file string, game_index int, ply_number int, uci string, fen_before string, legal_moves_count int, game_phase string")
    moves = batch.run(spark, root, positions=positions, lines=lines).moves
    row = moves.filter("source_file = 'unlabeled/b.pgn' and ply_number = 1").first()
    assert (row.centipawn_loss, row.is_engine_top1, row.move_quality, row.engine_score_before_cp, row.game_phase) == (10, 1, "Best", "30", "Opening")
    assert moves.filter("is_engine_eval_missing = 0").count() == 1


def test_csv_nulls_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None)], "game_id int, event string, site string")
    sinks.write_csv(df.coalesce(1).withColumn("extra", F.lit(1)), str(tmp_path / "c"), ["game_id", "event", "site"])
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert text == 'game_id,event,site\n1,"a ""b"", c",\n'


def test_output_path():
    assert sinks.engine_output_path("out/x.csv") == "out/x_engine_analysis.csv"
    assert sinks.engine_output_path("out.d/x") == "out.d/x_engine_analysis"


def test_a_failed_write_leaves_the_old_output(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame([(1, "a")], "id int, name string")
    sinks.write_csv(good, path, ["id", "name"])
    broken = good.withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    for write in (lambda: sinks.write_csv(broken, path, ["id", "name"]), lambda: sinks.write_document(broken, path)):
        with pytest.raises(Exception, match="broken"):
            write()
    assert [tuple(r) for r in spark.read.csv(path, header=True).collect()] == [("1", "a")]
    sinks.write_csv(spark.read.csv(path, header=True).withColumn("id", F.lit(2)), path, ["id"])  # reads what it replaces
    assert [tuple(r) for r in spark.read.csv(path, header=True).collect()] == [("2",)]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_manifest_files_flatten(spark, tmp_path):
    doc = {"files_processed": [{"file": "a", "category": "c", "moves_extracted": 3,
                                "provenance_audit": {"provenance_status": "s", "authenticity": "t"}}, {"file": "b"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    got = [tuple(r) for r in tables.manifest_files(spark, str(tmp_path / "m.json")).collect()]
    assert got == [("a", "c", 3, "s", "t"), ("b", None, None, None, None)]


def test_benchmark_reader_turns_nan_into_null(spark, tmp_path):
    row = {f.name: None for f in BENCHMARK_PLIES.fields} | {"game_id": "m_w", "normalized_centipawn_loss": float("nan")}
    spark.createDataFrame([tuple(row.values())], BENCHMARK_PLIES).write.parquet(str(tmp_path / "b"))
    got = tables.benchmark_plies(spark, str(tmp_path / "b")).first()
    assert got.normalized_centipawn_loss is None and len(got) == 33


def test_training_and_prediction(spark, tmp_path):
    plies = adapters.plies(spark, FOLDER)
    result = training.train(plies, order="ply_number")
    pooled = {r.model: r for r in result.pooled.collect()}
    assert set(pooled) == {"logistic_regression", "random_forest"}
    assert all(r.tn + r.fp + r.fn + r.tp == 400 for r in pooled.values())
    assert result.folds.count() == 5 and result.balance.first().positives == 160
    assert result.weights["random_forest"].count() == len(BASE_FEATURES)
    training.save(result, str(tmp_path / "m"))
    (report,) = _document(tmp_path / "m" / "model_metadata")
    assert report["split"]["n_splits"] == 5 and report["totals"] == {"player_games": 400, "groups": 200}
    assert report["feature_columns"] == BASE_FEATURES
    assert len(report["models"]) == 2 and len(report["cv_fold_metrics"]) == 10 and len(report["folds_summary"]) == 5
    model = models.load(str(tmp_path / "m" / "logistic_regression"))
    scored = prediction.predict(plies, adapters.engine_lines(plies), model, game="physical_game_id", played="move_player",
                                complexity_model=model)
    row = scored.first()
    assert scored.count() == 400
    assert row.card.primary_prob >= 0.5 and row.experimental.status == "compatible" and 0 <= row.experimental.score <= 1


def test_exploration_report(spark):
    plies = adapters.plies(spark, FOLDER)
    from turnwise.operators.enrich import enrich
    from turnwise.operators.profile import profile

    moves = enrich(plies, adapters.engine_lines(plies), keys=("physical_game_id", "ply_number"), played="move_player").drop("game_id").withColumn(
        "game_id", F.col("physical_game_id"))
    out = eda.report(moves, profile(moves, context=["event"]))
    sizes = {name: df.count() for name, df in out.items()}
    assert sizes["correlations"] == 49 and sizes["ranks"] == 6 and sizes["boxplot_game_phase"] == 3
    assert out["duplicate_moves"].first()[0] == 0 and out["duplicate_profiles"].first()[0] == 0


def test_bucketed_tables_enrich_without_a_shuffle(spark, tmp_path):
    from turnwise.operators.enrich import enrich

    keys = ["physical_game_id", "ply_number"]
    plies = adapters.plies(spark, FOLDER)
    for name, df in (("bucketed_plies", plies), ("bucketed_lines", adapters.engine_lines(plies))):
        sinks.save_bucketed(df, name, keys, 4, str(tmp_path / name))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = enrich(spark.table("bucketed_plies"), spark.table("bucketed_lines"), keys=keys, played="move_player")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert out.count() == 6000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_plies")
        spark.sql("drop table bucketed_lines")


def _checked(spark, path, text):
    """A file with the file system's checksums beside it."""
    name = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    out = name.getFileSystem(spark._jsc.hadoopConfiguration()).create(name)
    out.write(text.encode())
    out.close()


@pytest.mark.parametrize("kept", [0, 100, 70_000])
def test_a_truncated_file_is_one_reject_and_the_others_stay(spark, root, tmp_path, kept):
    for name in ("human_games/opera_game_1858.pgn", "unlabeled/a.pgn", "unlabeled/b.pgn"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text((Path(root) / name).read_text())
    long = tmp_path / "unlabeled" / "aa.pgn"
    _checked(spark, long, MINIMAL + "\n" + "\n".join([MINIMAL] * 1500))
    whole = batch.run(spark, str(tmp_path))
    assert whole.rejects.filter("source_file = 'unlabeled/aa.pgn'").count() == 0
    assert whole.files.filter("file = 'unlabeled/aa.pgn'").first().games_processed == 1501
    with open(long, "r+b") as file:
        file.truncate(kept)
    result = batch.run(spark, str(tmp_path))
    bad = {r.source_file: (r.source_category, r.error, r.game_index) for r in result.rejects.collect()}
    assert bad == {
        "unlabeled/a.pgn": ("unlabeled", "no mainline moves", 2),
        "unlabeled/aa.pgn": ("unlabeled", batch.UNREAD if kept else batch.NO_RECORDS, None),
    }
    assert result.moves.select("game_id").distinct().count() == 4 and result.moves.count() == 27


def test_bytes_read_add_up_to_the_size_of_a_file(spark, tmp_path):
    """Byte order mark, blank stretches, a separator at the end, no Event tag, no line end, bytes that aren't UTF-8."""
    texts = {
        "mark": "﻿" + MINIMAL, "blank": " \n\n", "end": MINIMAL + "\n[Event ", "bare": BARE, "start": "\n" + MINIMAL * 3,
        "raw": MINIMAL, "one": "x",
    }
    folder = tmp_path / "unlabeled"
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"{name}.pgn").write_bytes(text.encode() + (b"\n{\xff\xfe} e4 *" if name == "raw" else b""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    listed = games.list_categories(spark, str(tmp_path))
    try:
        for size in (old, "64b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            pieces = games.scan_category_pieces(spark, str(tmp_path))
            assert games.unread_files(pieces, listed).collect() == []
            part = pieces.filter("source_file <> 'unlabeled/bare.pgn' and not (source_file = 'unlabeled/start.pgn' and __at % 4 = 1)")
            lost = {r.source_file for r in games.unread_files(part, listed).collect()}
            assert "unlabeled/bare.pgn" in lost and lost <= {"unlabeled/bare.pgn", "unlabeled/start.pgn"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _tables(spark, *plies):
    """Two rows of one ply, and lines of each."""
    positions = spark.createDataFrame(
        [("unlabeled/b.pgn", 1, n, f"u{n}", text, 20, "Opening") for n in plies for text in ("x", "y")],
        "source_file string, game_index int, ply_number int, uci string, fen_before string, legal_moves_count int, game_phase string")
    lines = spark.createDataFrame(
        [("unlabeled/b.pgn", 1, n, side, 10, 1, f"u{n}" if side == "before" else None, n, None) for n in plies for side in ("before", "after")],
        "source_file string, game_index int, ply_number int, side string, depth int, pv_rank int, uci string, cp int, mate int")
    return positions, lines


@pytest.mark.parametrize("length", [1, 64])
def test_stretches_of_games_give_the_same_moves(spark, root, monkeypatch, length):
    """Cut after every ply or not at all; positions that come twice give two moves."""
    monkeypatch.setattr(batch, "RUN_PLIES", length)
    monkeypatch.setattr(batch, "run_of", lambda: enrich.run_of("ply_number", length))
    positions, lines = _tables(spark, 2, 5, 99)
    moves = batch.run(spark, root, positions=positions, lines=lines, tasks=3).moves
    assert enrich.RUN not in moves.columns and moves.count() == 27 + 2
    got = moves.filter("source_file = 'unlabeled/b.pgn'").orderBy("ply_number", "fen_before").collect()
    assert [(r.ply_number, r.uci, r.fen_before, r.engine_score_before_cp, r.is_engine_top1) for r in got if r.uci] == [
        (n, f"u{n}", text, str(n), 1) for n in (2, 5) for text in ("x", "y")]
    assert [r.ply_number for r in got] == sorted([*range(1, len(got) - 1), 2, 5])
    assert [r.player_color for r in got] == ["White" if r.ply_number % 2 else "Black" for r in got]


def test_games_are_dealt_out_before_they_become_plies(spark, root, monkeypatch):
    """The plies' join finds its rows in place, also where no table is small enough to be sent everywhere."""
    plans = []

    def seen(plies, lines, **more):
        out = enrich.enrich(plies, lines, **more)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(batch, "enrich", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        positions, lines = _tables(spark, 2)
        batch.run(spark, root, positions=positions, lines=lines, tasks=3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(source_file" in line]
    assert len(dealt) == 3 and all("__run" in line and "REPARTITION_BY_NUM" in line for line in dealt)


def test_files_of_a_written_table_hold_few_rows(spark):
    table = session.materialise(spark.range(100).coalesce(1), "few", rows_per_file=30)
    assert len(table.inputFiles()) == 4 and table.count() == 100


def test_compressed_outputs_hold_the_same_rows(spark, root, tmp_path):
    result = batch.run(spark, root)
    for kind in ("none", "gzip"):
        batch.write(result, str(tmp_path / kind), compression=kind)
    for name, read in (("move_level_features", tables.move_table), ("base_features", tables.base_ply_table),
                       ("base_features_engine_analysis", tables.engine_ply_table), ("player_game_features", tables.profile_table)):
        plain, packed = (sorted(map(str, read(spark, str(tmp_path / kind / name)).collect())) for kind in ("none", "gzip"))
        assert plain and plain == packed
        assert all(p.name.endswith(".csv.gz") for p in (tmp_path / "gzip" / name).glob("part-*"))
        assert all(p.name.endswith(".csv") for p in (tmp_path / "none" / name).glob("part-*"))
