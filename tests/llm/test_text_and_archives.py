import base64
import hashlib
import io
import random
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

from residua.llm import queries as Q
from residua.llm import warc_zip as W
from residua.llm.licence_rules import licence_scan, licence_sql
from residua.llm.local_descriptors import DescriptorConfig, Describer, consensus, edited_copy, find_copies, render_vector
from residua.llm.queries import op4_local_image_descriptors
from residua.llm.piece_transducer import PieceIds, encode_documents
from residua.llm.rendezvous import rendezvous_sql


def reader(raw):
    return (lambda at, n: raw[at : at + n]), len(raw)


def test_zip64_members_and_stored_ranges():
    out = io.BytesIO()
    size = W.write_zip64(out, [("a/b", b"12345"), ("empty", b""), ("é", b"x" * 1000)])
    raw = out.getvalue()
    assert size == len(raw)
    assert zipfile.ZipFile(io.BytesIO(raw)).read("a/b") == b"12345" and zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    read_at, n = reader(raw)
    got = {m["name"]: m for m in W.members_of(read_at, n)}
    assert list(got) == ["a/b", "empty", "é"] and read_at(W.stored_at(read_at, got["é"]), 1000) == b"x" * 1000


def test_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored")
        z.writestr("d", b"deflated" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    read_at, n = reader(out.getvalue())
    got = {m["name"]: m for m in W.members_of(read_at, n)}
    assert read_at(W.stored_at(read_at, got["s"]), 6) == b"stored"
    with pytest.raises(W.ArchiveError):
        W.stored_at(read_at, got["d"])
    for broken in (b"", b"PK", out.getvalue()[:-30], b"\0" * 70_000):
        with pytest.raises(W.ArchiveError):
            W.members_of(*reader(broken))


def test_round_trip_of_pages(spark):
    rows = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "v\r\nX", "<p>é</p>"), (3, "w", None), (4, "w", ""), (6, "w", "a\r\n\r\nb" * 9), (None, "n", "lone"), (7, "z", "y" * 3_000_000), (8, "r", "r"), (8, "r", "r")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = W.read_archives(W.write_archives(pages, W.archive_folder(spark))).collect()
    assert len(got) == 10
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[2].refers_to, by[5].record_type, by[3].refers_to) == ("revisit", 5, 5, "response", 4)
    assert bytes(by[6].payload) == b"a\r\n\r\nb" * 9 and by[7].payload_bytes == 3_000_000 and by[8].record_type == "response" and by[None].record_type == "response"
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (by[page].payload_bytes, by[page].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    plain = {r.page_id: r.record_type for r in W.read_archives(W.write_archives(pages, W.archive_folder(spark), min_revisit_bytes=5)).collect()}
    assert plain[3] == "response" and plain[1] == "revisit"
    assert W.read_archives(W.write_archives(pages.limit(0), W.archive_folder(spark))).collect() == []


def merged(model, text):
    """BPE by its merges: the best score first, the leftmost among equals."""
    symbols = list(text)
    while True:
        open_ = [(-model.score[k], i) for i in range(len(symbols) - 1) if (k := model.ids.get(symbols[i] + symbols[i + 1])) is not None]
        if not open_:
            return symbols
        _, i = min(open_)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_transducer_equals_the_library(spark, edge, no_docs):
    path = Q.tokenizer_path("piece_bpe_32k.model")
    own, lib = PieceIds(path), sentencepiece.SentencePieceProcessor(model_file=path)
    own.table.most = 2000  # starts anew now and then
    r = random.Random(1)
    letters = "abcdeiot   \n\tABé漢字😀'’.,0123 the ing▁́ "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    pieces = list(own.model.ids)
    texts += ["".join(r.choice(pieces).strip("▁") for _ in range(r.randint(10, 60))) for _ in range(100)]
    texts += [" " * k + "the" + "=" * k for k in range(80)] + ["abcé " * 300_000, "y" * 3000]
    for x, ids in zip(texts, own.of_all(texts)):
        assert ids.tolist() == lib.encode(x)
        assert own.decode(ids) == lib.decode(ids.tolist())
    machine = own.machine
    for _ in range(60):  # both searches give the path of the merges
        x = "".join(r.choice("theinr") for _ in range(r.randint(1, 32)))
        row = machine.alphabet[[ord(c) for c in x]].astype(np.int64)
        arcs, n = machine.shortest_paths(row[None])
        assert [machine.arcs[a][0] for a in arcs] == [machine.arcs[a][0] for a in machine.long_path(row.tolist())] == merged(own.model, x) and n.tolist() == [len(arcs)]
    rows = {x.doc_id: x for x in encode_documents(edge, path).collect()}
    assert all(x.round_trip for x in rows.values()) and rows[3].n_ids == rows[4].n_ids == 0
    for x in edge.collect():
        assert rows[x.doc_id].ids_crc32 == zlib.crc32(np.array(lib.encode(x.text or ""), "<u4").tobytes())
    assert encode_documents(no_docs, path).collect() == []


MIT_TEXT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE_TEXT = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, You
can obtain one at https://mozilla.org/MPL/2.0/."""


def test_licences_of_wrapped_texts(spark):
    cases = {
        "MIT": MIT_TEXT, "Apache-2.0": APACHE_TEXT, "GPL-3.0-or-later": GPL_TEXT.replace("\n", "\r\n"), "BSD-3-Clause,BSD-2-Clause": BSD_TEXT,
        "MPL-2.0": MPL_TEXT, "BSD-2-Clause": BSD_TEXT.replace("\n\n3. Neither", "\n\n3. The"),
    }
    apart = ["Released under the\n\nMIT License.", "We are licensed under. CC0 1.0", "Licensed under\n * \n * CC0 1.0"]
    rows = [(i, t) for i, t in enumerate([*cases.values(), *apart])]
    got = {r.doc_id: r for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licences for i in range(len(rows))] == [*cases, *[""] * len(apart)]
    assert got[0].sentence_ids == "<mit-grant><mit-condition>" and got[0].first_sentence == 3  # "A. Person" is a cut
    assert got[1].sentence_ids == "<apache-notice><apache-compliance><apache-copy><apache-as-is>"


def test_noise_does_not_hide_a_sentence(spark):
    text = "Licensed " + "*" * 900 + " under the " + "*" * 900 + " MIT license."
    docs = spark.createDataFrame([(1, text), (2, "word " * 300 + ". Released under the MIT license.")], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = docs.transform(licence_scan).orderBy("doc_id").toPandas()
    assert got["licence"].tolist() == ["MIT", "MIT"] == con.sql(licence_sql()).df().sort_values("doc_id")["licence"].tolist()


def test_licences(spark, edge, no_docs):
    more = [
        (100, "x.\nLicensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "en", 1),
        (101, "Released under the MIT License!\nLicensed under CC BY-NC 4.0.", "en", 1),
        (102, "ALL RIGHTS RESERVED", "en", 1),
        (103, "I wrote about the MIT license. Released under the MIT License for now", "en", 1),
    ]
    docs = edge.unionAll(spark.createDataFrame(more, edge.schema))
    got = licence_scan(docs).toPandas()
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.licence[100] == "Apache-2.0" and by.sentence_ids[100] == "<apache-notice><apache-compliance>" and by.first_sentence[100] == 1
    assert by.licences[101] == "CC-BY-NC-4.0,MIT" and by.conflict[101] and by.licence[102] == "proprietary" and by.n_matches[103] == 0 and by.licence[1] is None
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(licence_sql()).df()
    key = lambda d: sorted(map(str, d.fillna(-1).astype({"doc_id": float, "first_sentence": float}).values.tolist()))
    assert key(got[want.columns]) == key(want)
    assert licence_scan(no_docs).collect() == []


def test_shard_sql(spark, edge):
    con = duckdb.connect()
    con.register("documents", edge.where("length(text) < 5000 or text is null").toPandas().astype({"doc_id": "Int64"}))
    from residua.llm.rendezvous import rendezvous_shards

    got = rendezvous_shards(edge.where("length(text) < 5000 or text is null")).toPandas()
    want = con.sql(rendezvous_sql()).df()
    key = lambda d: sorted(map(str, d.fillna(-1).astype({"doc_id": float}).values.tolist()))
    assert key(got[want.columns]) == key(want)


def test_every_image_of_a_class_is_named(spark, tmp_path):
    r = np.random.default_rng(3)
    vectors = [[float(x) for x in r.normal(size=64)] for _ in range(30)]
    rows = [(i, vectors[0] if i in (20, 21) else v) for i, v in enumerate(vectors)] + [(5, vectors[5]), (None, vectors[1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op4_local_image_descriptors(spark, str(tmp_path)).collect()
    pairs = {(x.query_id, x.image_id) for x in got if x.member_id is None}
    members = [(x.member_id, x.image_id) for x in got if x.member_id is not None]
    assert all((x.query_id is None) == (x.inliers is None) == (x.member_id is not None) for x in got)
    assert sorted(members) == [(i, 0 if i in (20, 21) else i) for i in range(30)]
    assert (20, 20) in {(q, m) for q, c in pairs for m, c2 in members if c == c2} and pairs <= {(0, 0), (20, 0)}


def test_copies_are_found(spark):
    r = np.random.default_rng(2)
    vectors = [[float(x) for x in r.normal(size=64)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(60, vectors[0]), (61, None), (62, []), (None, vectors[1]), (0, vectors[0]), (63, [1.0] * 64)]
    images = spark.createDataFrame(rows, "id long, source array<double>")
    got = {(x.query_id, x.image_id) for x in find_copies(images, images.where("id % 3 = 0"), lambda v, k: render_vector(v), lambda v, k: edited_copy(render_vector(v), k)).collect()}
    asked = range(0, 60, 3)
    assert sum((i, i) in got for i in asked) >= 0.9 * len(asked)
    assert (60, 0) in got and not any(q != i for q, i in got if (q, i) != (60, 0))
    none = images.limit(0)
    assert find_copies(none, none, lambda v, k: render_vector(v), lambda v, k: render_vector(v)).collect() == []


def test_copies_equal_brute_force(spark):
    """All pairs of pictures: keys compared one by one, then the whole comparison."""
    r = np.random.default_rng(7)
    vectors = [[float(x) for x in r.normal(size=64)] for _ in range(24)]
    vectors += [[x + float(e) for x, e in zip(v, r.normal(scale=0.02, size=64))] for v in vectors[:6]]
    images = spark.createDataFrame(list(enumerate(vectors)), "id long, source array<double>")
    conf = DescriptorConfig()
    got = {(x.query_id, x.image_id): x.inliers for x in find_copies(images, images.where("id % 2 = 0"), lambda v, k: render_vector(v), lambda v, k: edited_copy(render_vector(v), k), conf).collect()}
    own, want, width = Describer(conf), {}, 32 // conf.tables
    f4 = lambda p: p.astype("<f4").astype(float)
    for q in range(0, 30, 2):
        qp, qb = own.describe(edited_copy(render_vector(vectors[q]), q))
        for i in range(30):
            p, b = own.describe(render_vector(vectors[i]))
            meets = sum(any((x[t * width : (t + 1) * width] == y[t * width : (t + 1) * width]).all() for y in b for t in range(conf.tables)) for x in qb)
            n = consensus(f4(p), b, f4(qp), qb, conf)
            if meets >= conf.min_meets and n >= conf.min_inliers:
                want[q, i] = n
    assert got == want and len(want) >= 15
