"""Standard headers, wrapped, unwrapped and commented out."""

from __future__ import annotations

import textwrap

import pytest

from panelvar.llm import licenses

MIT = """Copyright (c) 2020 A Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""
BSD2 = """Copyright (c) 2020, A Holder

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
GPL3_ONLY = GPL3.replace("either version 3 of the License, or (at your option) any later version", "version 3 of the License")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
HEADERS = [
    (MIT, "mit"),
    (BSD2, "bsd-2-clause"),
    (BSD3.format("the copyright holder"), "bsd-3-clause"),
    (BSD3.format("Example Inc."), "bsd-3-clause"),
    (GPL2, "gpl-2.0-or-later"),
    (GPL3, "gpl-3.0-or-later"),
    (GPL3_ONLY, "gpl-3.0"),
    (APACHE, "apache-2.0"),
    (MPL, "mpl-2.0"),
]


def forms(text: str):
    yield text
    for width in (30, 60, 72):
        wrapped = "\n\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in text.split("\n\n"))
        yield wrapped
        yield wrapped.replace("\n", "\r\n")
        for mark in ("# ", " * ", "// ", ";; ", "-- "):
            yield "\n".join(mark + x for x in wrapped.split("\n"))


def test_standard_headers_in_every_form(spark):
    rows = [(k, form) for k, (text, _) in enumerate(HEADERS) for form in forms("Some prose first.\n\n" + text + "\n\nint main() {}")]
    got = licenses.scan(spark.createDataFrame(rows, "k int, text string")).collect()
    assert len(got) == len(rows)
    assert [] == [(r["doc"]["text"], r["licence"]) for r in got if r["licence"] != HEADERS[r["doc"]["k"]][1]]


@pytest.mark.parametrize("text", ["Neither the name of the river nor the names of its banks are known.", "Permission is hereby granted, free of charge, to enter."])
def test_prose_is_no_licence(spark, text):
    assert licenses.scan(spark.createDataFrame([(text,)], "text string")).first()["licence"] is None
