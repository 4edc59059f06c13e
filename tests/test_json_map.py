"""Objects by line or by file; broken, doubled and trailing text raises."""

import pytest

from lectio.sources import read_json_map


def read(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    return sorted((r.key, r.value) for r in read_json_map(spark, str(tmp_path)).collect())


def test_lines_and_whole_files(spark, tmp_path):
    got = read(spark, tmp_path, a='{"1": 2.0}\n\n{"2": 3, "3": null}\n', b='\n{\n "4": 1.5,\n "x}{": 2\n}\n', c="", d="{}", e='{"7":\n 1}')
    assert got == [("1", 2.0), ("2", 3.0), ("3", None), ("4", 1.5), ("7", 1.0), ("x}{", 2.0)]


@pytest.mark.parametrize("text", [
    '{"1": 2.0}\n{"2": 1.0}\n{"3": 2.0}\n{"4": \n{"5": 1.0}',          # one broken line among good ones
    '{"1": 2.0}\n{"1": 3.0, "2": \n',
    '{"1": 2.0} {"2": 3.0}', '{"1": 2.0}, {"2": 3.0}', '{\n"1": 2.0\n}\n{\n"2": 3.0\n}', '{\n"1": 2.0\n} rest',
    '{"1": "word"}', '[{"1": 2.0}]', "17", '{\n"1": 2.0\n',
])
def test_nothing_is_lost_silently(spark, tmp_path, text):
    with pytest.raises(Exception, match="not one JSON object: .*a.json"):
        read(spark, tmp_path, a=text)
