import pytest

from inkflow import config as c


@pytest.mark.parametrize("text, expected", [("150", 100), ("100", 100), ("99", 99), ("1", 1), ("0", 70), ("-5", 70), ("+7", 7)])
def test_percent(text, expected):
    assert c.percent(text, 70) == expected


@pytest.mark.parametrize("text", ["abc", " 7 ", "1.5", "", "9" * 30])
def test_percent_refuses(text):
    with pytest.raises(c.OptionError):
        c.percent(text, 70)


def test_charsets():
    assert c.parse_charsets("ja,zh") == ("ShiftJIS", "GB18030")
    assert c.parse_charsets("JA,ja") == ("ShiftJIS",)
    assert c.parse_charsets("ja,ja-jp") == ("ShiftJIS", "ShiftJIS")
    assert c.format_charsets(("ShiftJIS", "ShiftJIS", "EUC-KR")) == "ja,ko"
    for bad, named in (("ja, zh", " zh"), ("xx,yy", "yy")):
        with pytest.raises(c.OptionError, match=named):
            c.parse_charsets(bad)
    with pytest.raises(c.OptionError):
        c.parse_charsets("")


@pytest.mark.parametrize("source, output", [("/d/x.zip", "/d/x_resize.zip"), ("/d/x.rar", "/d/x_resize.rar.zip"), ("/d/x", "/d/x_resize.zip"), ("/d/x.ZIP", "/d/x_resize.ZIP.zip")])
def test_default_output(source, output):
    assert c.default_output(source) == output


def test_config_checks_its_paths(tmp_path):
    with pytest.raises(c.OptionError, match="does not exist"):
        c.Config(str(tmp_path / "none.zip"))
    source = tmp_path / "a.rar"
    source.write_bytes(b"")
    assert c.Config(str(source)).output == str(tmp_path / "a_resize.rar.zip")
    (tmp_path / "a_resize.rar.zip").write_bytes(b"")
    with pytest.raises(c.OptionError, match="exists"):
        c.Config(str(source))
    with pytest.raises(c.OptionError):
        c.Config(str(source), output=str(tmp_path / "b"), kernel="sharp")
    with pytest.raises(c.OptionError):
        c.Jpeg(dct="fast")
