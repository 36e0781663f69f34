"""License scans: phrases of one licence must stand where its template has them."""

from sozlab.llm import licenses

GAP = "word " * 40
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS"'
)
TEXTS = {
    1: MIT,
    2: GAP + MIT,
    3: MIT.replace("subject to", GAP),
    4: "GNU General Public License as published by the Free Software Foundation, either version 3 of it",
    5: "GNU General Public License " + GAP + "version 3",
    6: "GNU General Public License " + GAP + "GNU General Public License, version 3",
    7: "Licensed under the Apache License, Version 2.0 (the License)",
    8: "Licensed under the Apache License. " + GAP + "Version 2.0",
    9: "the software is provided as is. permission is hereby granted free of charge",
    10: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    11: "GNU General Public License " + "x " * 15 + "y version 3",
    12: "GNU General Public License " + "x " * 16 + "y version 3",
    13: "version 3 " * 20_000 + "GNU General Public License " * 20_000,
}


def test_phrases_meet_by_relative_position(spark):
    frame = spark.createDataFrame([(i, t) for i, t in TEXTS.items()], "doc_id long, text string").repartition(3)
    rows = licenses.scan_licenses(frame).collect()
    got = {r.doc_id: set(r.labels.split(",")) for r in rows}
    places = {r.doc_id: {(p.phrase, p.start) for p in r.places} for r in rows}
    assert places[10] == {(p, o) for p, o in licenses.MORE["bsd"].items()}
    assert places[2] == {(p, 40 + o) for p, o in licenses.MORE["mit-text"].items()}
    assert "mit-text" in got[1] and "mit-text" in got[2] and "mit-text" not in got[3] and "mit-text" not in got[9]
    assert "gpl-3" in got[4] and "gpl-3" not in got[5] and "gpl-3" in got[6]
    assert "apache-2" in got[7] and "apache-2" not in got[8] and got[8] == {"apache"}
    assert "bsd" in got[10]
    assert "gpl-3" in got[11] and "gpl-3" not in got[12] and "gpl-3" in got[13]
