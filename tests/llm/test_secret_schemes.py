import time

from tidemark.llm.secret_scan import WORDS, find_spans, ranks


def guesses(text):
    return [text[a:b] for kind, a, b in find_spans(text, ranks(WORDS), 8.0, 6) if kind == "guess"]


def test_the_credential_behind_a_scheme_word():
    hard = "xK9vQ2mLw7Tz"
    assert guesses(f"Authorization: Bearer {hard} and more") == [hard]
    assert guesses(f'"authorization": "Basic {hard}"') == [hard]
    assert guesses(f"Authorization: Bearer token={hard}") == [hard]
    assert guesses(f"auth: basic my_password={hard}") == [hard]
    assert guesses(f"password: {hard}") == [hard] and guesses("Authorization: Bearer") == []
    assert guesses("token: xK9vQ2m") == [] and guesses("token: xK9vQ2mL") == ["xK9vQ2mL"]


def test_long_values_behind_scheme_words_take_linear_time():
    begun = time.monotonic()
    assert guesses("auth: bearer " + "p" * 20_000) == [] and guesses("auth: bearer " * 20_000) == []
    assert time.monotonic() - begun < 20
