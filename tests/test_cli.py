import gzip

from helixsieve.__main__ import main


def text(folder):
    return b"".join(gzip.open(p).read() if p.name.endswith(".gz") else p.read_bytes() for p in sorted(folder.glob("part-*"))).decode()


def test_filter(spark, tmp_path):
    rows = [("A" * 40, "C" * 40), ("ACGT" * 10, "N" * 40), ("A" * 40, "C" * 40), ("GATTACA" * 6, "T" * 10)]
    for m in (0, 1):
        (tmp_path / f"r{m + 1}.fq").write_text("".join(f"@r{i}/{m + 1}\n{r[m]}\n+\n{'I' * len(r[m])}\n" for i, r in enumerate(rows)))
    (tmp_path / "config").write_text("rmdup\n")
    main(["filter", "-1", str(tmp_path / "r1.fq"), "-2", str(tmp_path / "r2.fq"), "-o", str(tmp_path / "out"), "-c", str(tmp_path / "config"), "-n", "0.5", "--plots", "--trimmed"])
    assert text(tmp_path / "out/clean_1.fq.gz") == f"@r0/1\n{'A' * 40}\n+\n{'I' * 40}\n"
    assert text(tmp_path / "out/copies_2.fq.gz") == f"@r2/2\n{'C' * 40}\n+\n{'I' * 40}\n"
    assert text(tmp_path / "out/trimmed_1.fq.gz").count("@r") == 4
    report = dict(line.split("\t")[:2] for line in text_csv(tmp_path / "out/report_filter").splitlines())
    assert report == {"reason": "total", "total": "3", "duplicate": "1", "n_ratio": "1", "short": "1"}
    for name in ("good", "base", "quality"):
        assert text(tmp_path / f"out/plot_{name}").startswith("<svg")


def text_csv(folder):
    return next(folder.glob("part-*.csv")).read_text()


def test_alignments_and_barcodes(spark, tmp_path):
    line = lambda q, f, s: "\t".join([q, str(f), "*", "0", "0", "*", "*", "0", "0", s, "I" * len(s)])
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n" + "\n".join([line("a", 65, "ACGT" * 10), line("a", 129, "ACGT" * 10), line("b", 65, "N" * 40), line("b", 129, "ACGT" * 10)]) + "\n")
    main(["filterHts", "-1", str(tmp_path / "x.sam"), "-o", str(tmp_path / "hts")])
    got = [x.split("\t")[1] for x in "".join(p.read_text() for p in sorted((tmp_path / "hts/marked.sam").glob("part-*"))).splitlines()]
    assert got == ["VN:1.6", "65", "129", str(65 + 512), str(129 + 512)]  # the header is kept
    (tmp_path / "b").write_text("AAAAA 1\nCCCCC 2\n")
    for m, s in ((1, "ACGT" * 10), (2, "GGCC" * 10 + "AAAAACCCCCAAAAA")):
        (tmp_path / f"s{m}.fq").write_text(f"@x/{m}\n{s}\n+\n{'I' * len(s)}\n")
        (tmp_path / f"l{m}").write_text(f"{tmp_path}/s{m}.fq\n")
    (tmp_path / "c").write_text(f"inputAsList\nbarcodeRegionStr=41_5,46_5,51_5\nbarcodeListPath={tmp_path}/b\n")
    main(["filterStLFR", "-1", str(tmp_path / "l1"), "-2", str(tmp_path / "l2"), "-o", str(tmp_path / "lfr"), "-c", str(tmp_path / "c")])
    assert text(tmp_path / "lfr/clean_2.fq.gz").splitlines()[:2] == ["@x#1_2_1/2", "GGCC" * 10]
