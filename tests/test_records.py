"""Records of JSON documents cut by byte ranges, against the whole document read at once."""

import json
import random

import pytest

from loomfield.sources import files, records


def _document(rng, n):
    odd = ['a "quoted" name', "back\\slash\\", "brace } and [bracket", "é漢字", "", '\\"', "images", "tab\t\n{", "\\\\\\" * 9]
    images = [{"id": i, "file_name": rng.choice(odd) + str(i), "height": i % 7, "width": 3, "nested": {"deep": [{"x": "}]"}]}} for i in range(n)]
    annotations = [{"id": i, "image_id": i % max(n, 1), "category_id": i % 3, "bbox": [0.5, 1, 2, i], "area": i / 2, "iscrowd": i % 2, "segmentation": rng.choice([[[1.5, 2, 3]], {"counts": 'a"\\{', "size": [1, 2]}])} for i in range(2 * n)]
    categories = [{"id": i, "name": rng.choice(odd)} for i in range(3)]
    parts = {"info": {"description": "images", "x": {"images": [{"id": 99}]}}, "note": "annotations", "images": images, "licenses": [{"id": 7, "name": "n"}], "annotations": annotations, "categories": categories}
    keys = list(parts)
    rng.shuffle(keys)
    return {k: parts[k] for k in keys}


@pytest.mark.parametrize(("range_bytes", "indent", "ascii_only"), [(17, None, True), (64, 2, False), (1000, None, False), (1 << 20, 1, True)])
def test_records_of_any_range_are_those_of_the_document(spark, tmp_path, monkeypatch, range_bytes, indent, ascii_only):
    monkeypatch.setattr(records, "MORE_BYTES", 16)  # records go on past it; names of arrays don't
    rng = random.Random(range_bytes)
    docs = [_document(rng, n) for n in (12, 0, 3)]
    (tmp_path / "one.json").write_text(json.dumps(docs[0], indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    (tmp_path / "two.json").write_text("\n".join(json.dumps(d, ensure_ascii=ascii_only) for d in docs[1:]), encoding="utf-8")
    (tmp_path / "none.json").write_text("")
    images, annotations, categories = files.src_coco_tables(spark, str(tmp_path), range_bytes)
    every = lambda name, *keys: sorted(tuple(map(str, (r.get(k) for k in keys))) for d in docs for r in d[name])
    got = lambda df, *keys: sorted(tuple(str(r[k]) for k in keys) for r in df.collect())
    assert got(images, "id", "file_name", "height", "width") == every("images", "id", "file_name", "height", "width")
    assert got(annotations, "id", "image_id", "category_id", "area", "iscrowd") == every("annotations", "id", "image_id", "category_id", "area", "iscrowd")
    assert sorted(r["bbox"] for r in annotations.collect()) == sorted([float(x) for x in r["bbox"]] for d in docs for r in d["annotations"])
    assert got(categories, "id", "name") == every("categories", "id", "name")


def test_compressed_files_are_refused_and_broken_ones_too(spark, tmp_path):
    (tmp_path / "a.json.gz").write_bytes(b"xx")
    with pytest.raises(Exception, match="compressed"):
        files.src_coco_tables(spark, str(tmp_path))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"images": [{"id": 1}, {"id": 2')
    images, _, _ = files.src_coco_tables(spark, str(tmp_path / "b"))
    with pytest.raises(Exception, match="ends within a record"):
        images.collect()


def test_escapes_and_brackets():
    data = rb'{"a\"{": [1, "\\"], "b]": {}}'
    for cut in range(len(data)):
        escaped = (len(data[:cut]) - len(data[:cut].rstrip(b"\\"))) % 2 == 1
        left, right = records.marks(data[:cut], False), records.marks(data[cut:], escaped)
        whole = records.marks(data, False)
        assert [*left.at, *(right.at + cut)] == list(whole.at) and [*left.step, *right.step] == list(whole.step)


def test_a_record_may_be_longer_than_many_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MORE_BYTES", 8)
    long = {"id": 1, "text": '}{"\\' * 300, "more": [{"a": [i]} for i in range(50)]}
    data = json.dumps({"x": [{"id": 0}], "rows": [long, {"id": 2}]}).encode()
    (tmp_path / "a.json").write_bytes(data)
    found, inside, depth, section = [], False, 0, None
    for begin in range(0, len(data), 11):
        end = min(begin + 11, len(data))
        found += [json.loads(r) for r in records.records_of(str(tmp_path / "a.json"), begin, end, inside, depth, section, "rows")]
        part, escaped = records._read(str(tmp_path / "a.json"), begin, end)
        m = records.marks(part, escaped)
        _, names = records.names_at_top(data[begin : end + 8], records.marks(data[begin : end + 8], escaped), inside, depth, end - begin)
        outside, _ = records._depths(m, inside, depth)
        inside, depth, section = (int((m.step == 0).sum()) + inside) % 2 == 1, depth + int(m.step[outside].sum()), names[-1] if names else section
    assert found == [long, {"id": 2}]
