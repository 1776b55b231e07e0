"""Plain versions of what the operators read."""

import re


def words_of(text):
    return (text or "").encode().split()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
