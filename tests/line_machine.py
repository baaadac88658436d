"""Independent oracle of the tests: one pass over the lines of one file, in plain Python."""

import re

SEP = " \t "
KNOWN = ("ERROR", "WARN", "INFO")


def is_header(line):
    return bool(re.match(r"\d\d/\d\d/\d\d|\d{4}-\d\d-\d\d", line, re.ASCII))


def pieces(text):
    """[(rec_no, level, raw)]; record 0 are the lines before the first header."""
    out, number = [], 0
    for line in text.split("\n"):
        if is_header(line):
            number += 1
            tokens = line.split()
            out.append([number, tokens[2] if len(tokens) > 2 else "", [line]])
        elif out:
            out[-1][2].append(line)
        else:
            out.append([0, None, [line]])
    return [(n, level, "\n".join(lines)) for n, level, lines in out]


def has_short_header(text):
    return any(is_header(line) and len(line.split()) < 3 for line in text.split("\n"))


def segments(text):
    """[(level, record)], with gaps of unknown levels merged, before the INFO filter."""
    done, current, last = [], None, None
    for number, level, raw in pieces(text):
        if number == 0:
            continue
        if level in KNOWN:
            record = "".join(line + SEP for line in raw.split("\n"))
            if current and current[0] == level and last not in KNOWN:
                current[1] += record
            else:
                if current:
                    done.append(tuple(current))
                current = [level, record]
        last = level
    if current and last in KNOWN:
        done.append(tuple(current))
    return done


def kept(text):
    return [(lv, r) for lv, r in segments(text) if lv != "INFO" or "Caused by:" in r]


def spans(text, keywords):
    out = []
    for _, _, raw in pieces(text):
        span = ""
        for line in raw.split("\n"):
            if any(k in line.lower() for k in keywords):
                span += line + SEP
            elif span:
                span += line
        if span:
            out.append(span[1:] if not out and span[0] == "\t" else span)
    return out
