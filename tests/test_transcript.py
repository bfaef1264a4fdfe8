from marklake.operators.transcript import render_transcript
from payloads import cursor, document, entry, frame, main, note, post, reply, url


def test_transcripts(spark):
    links = [url("https://t.co/b", "B", 0, 0), url("https://t.co/a", "A", 0, 0)]
    quoting = dict(permalink="https://q", quoted_status_result={"result": post("9", " quoted ", screen="bob")})
    gone = dict(quoted_status_result={"result": {"__typename": "TweetTombstone"}})
    no_link = dict(quoted_status_result={"result": post("9", "quoted", screen="bob")})
    docs = {
        "full": document(
            main(post("1", "said https://t.co/a https://t.co/b ", urls=links, **quoting)),
            reply(post("2", "re", screen="eve", **quoting)),
            reply(),
            entry("cursor-bottom-1", cursor()),
            main(post("3"), "tweetdetailrelatedtweets-1"),
            reply(post("4", "x", screen="", note_tweet=note(" note https://t.co/a", links))),
            reply(post("5", "y", **gone)),
        ),
        "trailing": document(main(post("1", "z https://t.co/b https://t.co/a", urls=links))),
        "no_main": document(reply(post("2", "alone"))),
        "gone_main": document(main({"__typename": "TweetTombstone"})),
        "empty": document(),
        "blank_main": document(main(post("1", "  ")), reply(post("2", "re"))),
        "no_link": document(main(post("1", "m", **no_link))),
        "invalid": document(main({"__typename": "Strange"})),
    }
    found = {r.conv_id: r.transcript for r in render_transcript(frame(spark, **docs)).collect()}
    assert found["full"] == "\n".join([
        # The text ends in a blank, so the first link is not at its end; the second one is not either.
        "Main Tweet by ann:", "said https://t.co/a https://t.co/b",
        "\nQuoting @bob:", "  quoted", "  Link to quoted tweet: https://q",
        "\nReplies:", "- eve: re", "  Quoting @bob:", "    quoted", "    Link to quoted tweet: https://q",
        "- : [No tweet text available]", "- : [No tweet text available]",
        "- Unknown User:  note https://t.co/a", "- ann: y",
    ])
    # Links are tried in list order: b is not at the end until a is cut.
    assert found["trailing"] == "Main Tweet by ann:\nz https://t.co/b"
    assert found["no_main"] == "\nReplies:\n- ann: alone"
    assert found["gone_main"] == found["empty"] == "[No content available]"
    assert found["blank_main"] == "\nReplies:\n- ann: re"
    assert found["no_link"] == "Main Tweet by ann:\nm\n\nQuoting @bob:\n  quoted"
    assert "invalid" not in found
