"""python -m tidewell COMMAND ...: reports over captures, session processing, made-up data and training."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import Network, Pipeline, Sensors
from tidewell.operators import detect, evaluate, model
from tidewell.plans import reports
from tidewell.plans.process import process_session
from tidewell.sources import captures, synthetic


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m tidewell", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *folders: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=what, description=what)
        for f in folders:
            c.add_argument(f)
        c.add_argument("--sensors", help="YAML settings of the sensors")
        return c

    command("inspect", "statistics of one session", "folder").add_argument("--stem")
    c = command("derive", "events from the pressure of all captures", "folder")
    c.add_argument("--out")
    c.add_argument("--dry-run", action="store_true", help="write nothing")
    c.add_argument("--band-cpm", nargs=2, type=float, default=(20.0, 120.0))
    c.add_argument("--convention", choices=[detect.TROUGH, detect.ONSET], default=detect.TROUGH)
    c.add_argument("--prominence-fraction", type=float, default=0.35)
    c = command("validate", "grades of all captures' sidecars", "folder")
    c.add_argument("--strict", action="store_true", help="end with 1 on errors")
    c.add_argument("--frozen", action="store_true")
    command("mic", "both microphones of the captures", "folder").add_argument("--limit", type=int)
    command("wraps", "rollovers of all counters", "folder").add_argument("--limit", type=int, default=6)
    command("strain", "strain events against reference events", "folder", "reference")
    command("volume", "volume from strain events", "folder", "reference")
    c = command("compare", "two score dumps against each other", "first", "second")
    c.add_argument("--value", default="signed_err_pct")
    command("acoustic", "rates from sound", "folder")
    c = command("run", "all sessions of a folder to windows", "folder")
    c.add_argument("--weights", help="also predict with this network")
    c.add_argument("--pipeline")
    c.add_argument("--out", help="write the windows here as parquet")
    c = command("synthesize", "a made-up flat session", "folder")
    c.add_argument("--seconds", type=float, default=20.0)
    c.add_argument("--total-ml", type=float, default=10.0)
    c.add_argument("--no-events", action="store_true")
    c.add_argument("--seed", type=int, default=0)
    c = command("pretrain", "a network from made-up sessions", "out")
    c.add_argument("--sessions", type=int, default=64)
    c.add_argument("--windows", type=int, default=60)
    c = command("finetune", "go on training with real sessions", "folder", "weights", "out")
    for name in ("pretrain", "finetune"):
        sub.choices[name].add_argument("--model", help="YAML settings of the network and its training")
        sub.choices[name].add_argument("--epochs", type=int)
    return p


def settings(a: argparse.Namespace) -> tuple[Network, model.Training]:
    return (Network.from_yaml(a.model), model.Training.from_yaml(a.model)) if a.model else (Network(), model.Training())


def processed(spark: SparkSession, folder: str, sensors: Sensors, pipeline: Pipeline | None = None):
    """All sessions of a folder; broken ones are left out and named."""
    return process_session(captures.load_sessions(spark, folder, sensors), captures.load_all_events(spark, folder), sensors, pipeline, strict=False)


def run(spark: SparkSession, a: argparse.Namespace, sensors: Sensors) -> dict[str, DataFrame]:
    pipeline = Pipeline.from_yaml(a.pipeline) if a.pipeline else Pipeline()
    done = processed(spark, a.folder, sensors, pipeline)
    if a.out:
        captures.write_table(done.windows, a.out)
    out = {"issues": done.issues, "sessions": done.windows.groupBy("session_id").agg(F.count(F.lit(1)).alias("windows"), F.count("label").alias("labelled"), (F.sum("volume") * done.correction).alias("volume_ml"))}
    if a.weights:
        got = model.predict(done.windows, model.load_weights(a.weights))
        out["predicted"] = evaluate.session_rollup(got, ["session_id"], "logits", "volume_pred", done.correction)
    return out


def train(spark: SparkSession, a: argparse.Namespace, sensors: Sensors) -> dict[str, DataFrame]:
    net, how = settings(a)
    if a.command == "pretrain":
        rows = synthetic.generate_sessions(spark, a.sessions, a.windows, hand=net.hand, channels=net.channels, seed=how.seed)
        w, history = model.fit(rows, model.init_weights(net, how.seed), how, a.epochs or how.epochs_synthetic, net)
    else:
        rows = processed(spark, a.folder, sensors).windows
        labelled = not how.need_labels or bool(rows.where("label is not null").take(1))
        w, history = model.fit(rows, model.load_weights(a.weights), how, a.epochs or how.epochs_finetune, net, labelled)
    model.save_weights(a.out, w)
    return {"epochs": spark.createDataFrame([(i, *map(float, h.values())) for i, h in enumerate(history)], "epoch int, classification double, volume double, loss double")}


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    sensors = Sensors.from_yaml(a.sensors) if a.sensors else Sensors()
    if a.command == "synthesize":
        print(synthetic.write_session(a.folder, a.seconds, a.total_ml, not a.no_events, a.seed, sensors))
        return 0
    spark = SparkSession.builder.getOrCreate()
    dump = lambda path: spark.read.option("header", True).option("inferSchema", True).csv(path)
    got = {
        "inspect": lambda: reports.inspect_session(spark, a.folder, a.stem, sensors),
        "derive": lambda: reports.derive_events(spark, a.folder, detect.Detector(band_cpm=tuple(a.band_cpm), convention=a.convention, prominence_fraction=a.prominence_fraction), None if a.dry_run else a.out),
        "validate": lambda: reports.validate_dataset(spark, a.folder, a.frozen), "mic": lambda: reports.mic_health(spark, a.folder, a.limit), "wraps": lambda: reports.wrap_scan(spark, a.folder, a.limit),
        "strain": lambda: reports.strain_report(spark, a.folder, a.reference, sensors), "volume": lambda: reports.volume_report(spark, a.folder, a.reference, sensors),
        "compare": lambda: reports.compare_sources(dump(a.first), dump(a.second), value=a.value), "acoustic": lambda: reports.acoustic_report(spark, a.folder),
        "run": lambda: run(spark, a, sensors), "pretrain": lambda: train(spark, a, sensors), "finetune": lambda: train(spark, a, sensors),
    }[a.command]()
    for name, df in (got if isinstance(got, dict) else {a.command: got}).items():
        print(name)
        if isinstance(df, DataFrame):
            df.show(100, truncate=False)
        else:
            print(df)
    if a.command == "validate" and a.strict:
        return int(got["captures"].where("not ok").count() > 0)
    if a.command == "derive":
        return int(got.where("error is not null").count() > 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
