"""Every keyframe's byte range is returned, and at it lie the stored bytes of its sample."""

from needledrop.llm import media


def test_all_keyframes_are_returned(spark):
    texts = ["", "short", "".join(chr(97 + k // 192 % 26) for k in range(192 * 100 + 7))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    files = {r["doc_id"]: bytes(r["media"]) for r in media.stored(df).collect()}
    for r in media.round_trip(df).collect():
        data, payload = files[r["doc_id"]], media.padded(texts[r["doc_id"]].encode())
        ranges = [tuple(map(int, x.split("-"))) for x in r["key_ranges"].split(",")]
        assert len(ranges) == -(-(len(payload) // 192) // 16) == int(r["feature"].split(":")[3])
        assert [data[a:b] for a, b in ranges] == [payload[k : k + 192] for k in range(0, len(payload), 192 * 16)]
