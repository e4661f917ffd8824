"""Headers of licenses, long texts, and columns that have the names of the scan's own."""

import time

import pytest

HEADERS = [
    ("either version 3 of the License, or (at your option) any later version", "GNU General Public License", "gpl-3.0-or-later"),
    ("either version 2 of the License, or (at your option) any later version", "GNU General Public License", "gpl-2.0-or-later"),
    ("version 2 of the License", "GNU General Public License", "gpl-2.0-only"),
    ("either version 2.1 of the License, or (at your option) any later version", "GNU Lesser General Public License", "lgpl-2.1-or-later"),
    ("either version 2 of the License, or (at your option) any later version", "GNU Library General Public License", "lgpl-2.0-or-later"),
    ("either version 3 of the License, or (at your option) any later version", "GNU Affero General Public License", "agpl-3.0-or-later"),
]
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation, {version}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
OTHER = [
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', {"apache", "apache-2.0"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", {"bsd"}),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived", {"bsd-3-clause"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", {"isc"}),
    ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0-only"}),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", {"bsd"}),
    ("The software is licensed to nobody in particular.", set()),
]


def test_headers(spark):
    from lociweave.llm.license_scan import scan_licenses

    texts = [(GNU.format(name=name, version=version), {label, *(["gpl"] if "GNU General" in name else [])}) for version, name, label in HEADERS] + OTHER
    rows = [(i, t, "x", "y", "z") for i, (t, _) in enumerate(texts)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, __s string, __FLAT string, __found string"))
    got = {r.doc_id: r for r in out.collect()}
    assert {i: set(filter(None, got[i].labels.split(","))) for i in got} == {i: w for i, (_, w) in enumerate(texts)}
    assert all(tuple(r)[2:5] == ("x", "y", "z") for r in got.values())
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("size", [1_000_000])
def test_long_text(spark, size):
    from lociweave.llm.license_scan import scan_licenses

    one = GNU.format(name="GNU General Public License", version=HEADERS[0][0]) + "\n"
    scan_licenses(spark.createDataFrame([(0, one)], "doc_id long, text string")).collect()
    n = size // len(one)
    began = time.time()
    row = scan_licenses(spark.createDataFrame([(0, one * n)], "doc_id long, text string")).first()
    assert time.time() - began < 15
    assert row.labels == "gpl,gpl-3.0-or-later" and row.n_base == n and len(row.detections) == n
    w = len(one.replace("/", " ").split())
    assert [d.start for d in row.detections] == [row.detections[0].start + k * w for k in range(n)]
