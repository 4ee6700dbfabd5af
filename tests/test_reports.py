from corpuscle.sources import reports, sinks


def test_reports(spark, tmp_path):
    (tmp_path / "a.pka").write_text("ASP 3 A 9.99\nSUMMARY OF THIS PREDICTION\n   ASP   2 A   3.80   3.80\n   ARG  11 B  12.50  12.50\n")
    (tmp_path / "a_info.txt").write_text("Pocket 1 :\n\tScore : 0.52\n\tVolume : 310.5\nPocket 2 :\n\tScore : 0.1\n\tVolume : 120\n")
    (tmp_path / "v.log").write_text("mode | affinity | dist from best mode\n-----+-----+-----\n   1   -7.5   0.000   0.000\n   2   -7.1   1.200   2.500\n")
    (tmp_path / "v.pdbqt").write_text("MODEL 1\nREMARK VINA RESULT:   -7.5  0.0  0.0\nENDMDL\nMODEL 2\nREMARK VINA RESULT:   -7.1  1.2  2.5\nENDMDL\n")
    lines = lambda name: reports.report_lines(spark, str(tmp_path / name))
    assert {(r["resname"], r["residue_id"], r["chain_id"], r["pka"]) for r in reports.propka(lines("a.pka")).collect()} == {("ASP", 2, "A", 3.8), ("ARG", 11, "B", 12.5)}
    assert {(r["pocket"], r["score"], r["volume"]) for r in reports.fpocket(lines("a_info.txt")).collect()} == {(1, 0.52, 310.5), (2, 0.1, 120.0)}
    assert [(r["mode"], r["affinity"]) for r in reports.vina_scores(lines("v.log")).orderBy("mode").collect()] == [(1, -7.5), (2, -7.1)]
    assert {(r["pose"], r["score"]) for r in sinks.pdbqt_poses(lines("v.pdbqt")).collect()} == {(1, -7.5), (2, -7.1)}
