import pytest

from helixsieve.params import QCParams, parse_base_convert, parse_config, read_adapters


def test_config():
    text = """# comment
    contam1=ACGT,GGCC
    ctMatchR=0.3,0.4
    adaMis=3
    adaEdge=7,8
    totalReadsNum=1000head
    trim=1,2,3,4
    index
    outQualSys=1
    baseConvert=TtoU   # RNA
    barcodeRegionStr=1_10,20_10
    log=x.log
    """
    p = QCParams.from_config(text)
    assert p.contams1 == ("ACGT", "GGCC") and p.contam_ratios == (0.3, 0.4)
    assert (p.approx1.mismatches, p.approx1.edge, p.approx2.mismatches, p.approx2.edge) == (3, 7, 3, 8)
    assert p.head_reads == 1000 and p.hard_trim == (1, 2, 3, 4) and p.remove_index and p.phred_out == 64
    assert p.base_convert == ("T", "U") and p.barcode_regions == ((1, 10), (20, 10)) and p.extra == {"log": "x.log"}
    assert parse_config("totalReadsNum=0.1") == {"sample_reads": 0.1}
    with pytest.raises(ValueError, match="unknown"):
        parse_config("nonsense=1")


@pytest.mark.parametrize(
    "own",
    [{"module": "x"}, {"adapters1": ("ACX",)}, {"adapters2": ("A",), "paired": False}, {"module": "filterStLFR", "paired": False}, {"global_contams": ("A",)}, {"head_reads": 1, "sample_reads": 2}, {"split_reads": 1, "head_reads": 1}, {"hard_trim": (1, 2)}, {"phred_in": 50}, {"module": "filterHts", "adapter_mode": "trim"}],
)
def test_conflicts(own):
    with pytest.raises(ValueError):
        QCParams(**own)


def test_small():
    assert parse_base_convert("a2g") == ("A", "G")
    with pytest.raises(ValueError):
        parse_base_convert("TXU")
    assert read_adapters(["ACGT", "list"], lambda v: "GG\nCC\n" if v == "list" else None) == ("ACGT", "GG", "CC")
    assert QCParams.srna().max_length == 49
