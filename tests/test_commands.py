import os

import numpy as np
import pandas as pd
import pytest
from test_captures import write_rig

from tidewell.__main__ import main, parser
from tidewell.operators import model
from tidewell.sources.synthetic import write_session


def test_every_command_has_its_arguments():
    names = {"inspect", "derive", "validate", "mic", "wraps", "strain", "volume", "compare", "acoustic", "run", "synthesize", "pretrain", "finetune"}
    assert set(parser()._subparsers._group_actions[0].choices) == names
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_sessions_are_made_run_and_trained_on(spark, tmp_path, capsys):
    with open(tmp_path / "model.yaml", "w") as f:
        f.write("""model: {cnn: {in_channels: 16, channels: [4, 4], kernel_size: 3, embedding_dim: 4}, hand_feature_dim: 130, fusion_dim: 6, lstm: {hidden_size: 3, num_layers: 1, dropout: 0.0}, heads: {num_classes: 3}}
training: {batch_size: 4, lr: 0.01, weight_decay: 0.0001, epochs_synthetic: 2, epochs_finetune: 1, seed: 7, loss_weights: {classification: 1.0, volume: 1.0}, require_event_labels_for_classifier: true}
""")
    first, second = str(tmp_path / "a.npz"), str(tmp_path / "b.npz")
    assert main(["pretrain", first, "--sessions", "2", "--windows", "4", "--model", str(tmp_path / "model.yaml")]) == 0
    root = tmp_path / "root"
    for name in ("x", "y"):
        assert main(["synthesize", str(root / name), "--seconds", "7"]) == 0
    assert main(["finetune", str(root), first, second, "--model", str(tmp_path / "model.yaml")]) == 0
    a, b = model.load_weights(first), model.load_weights(second)
    assert set(a) == set(b) and any(not np.array_equal(a[k], b[k]) for k in a)
    capsys.readouterr()
    assert main(["run", str(root), "--out", str(tmp_path / "windows")]) == 0
    assert "labelled" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "windows")).count() == 10


def test_reports_over_captures(spark, tmp_path, capsys):
    rig = tmp_path / "rig"
    for name in ("a", "b"):
        write_rig(rig, name, seconds=45)
    period = 1000 / 0.7
    os.makedirs(tmp_path / "reference")
    for name in ("a", "b"):
        t = 1e6 + period / 2 + np.arange(30) * period
        pd.DataFrame({"t_ms": t, "quality": "ok", "depth_psi": 1.0}).to_csv(tmp_path / "reference" / f"{name}.csv", index=False)
    assert main(["derive", str(rig), "--out", str(tmp_path / "out"), "--dry-run"]) == 0 and not os.path.exists(tmp_path / "out")
    assert main(["derive", str(rig), "--out", str(tmp_path / "out")]) == 0 and os.path.exists(tmp_path / "out" / "events")
    assert main(["validate", str(rig), "--strict"]) == 1
    for command in (["wraps", str(rig)], ["mic", str(rig), "--limit", "1"], ["acoustic", str(rig)], ["strain", str(rig), str(tmp_path / "reference")]):
        assert main(command) == 0, command
    text = capsys.readouterr().out
    assert "consensus" in text and "n_wraps" in text and "within_2_cpm" in text
    rng = np.random.default_rng(0)
    for name in ("p", "q"):
        pd.DataFrame({"stem": range(12), "level": np.arange(12) % 3, "signed_err_pct": rng.standard_normal(12)}).to_csv(tmp_path / f"{name}.csv", index=False)
    assert main(["compare", str(tmp_path / "p.csv"), str(tmp_path / "q.csv")]) == 0


def test_flat_session_report(spark, tmp_path, capsys):
    folder = write_session(str(tmp_path / "s"), seconds=7)
    assert main(["inspect", folder]) == 0
    assert "measured_ml" in capsys.readouterr().out
