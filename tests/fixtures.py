"""Relations with their minimal dependencies: columns, rows and (left-hand side, right-hand side), all values text."""

# Rows and expected dependencies of the test relations.
FIXTURES = {
    "0": (
        ["PROF", "CSE", "DAY", "BEGIN", "END", "ROOM", "CAP", "ID"],
        [
            ("NF", "AL", "Tuesday", "09:00", "09:00", "A2", "150", "Monday"),
            ("DM", "NW", "Friday", "09:00", "09:00", "A2", "150", "Tuesday"),
            ("ML", "OS", "Monday", "09:00", "14:00", "I10", "30", "Wednesday"),
            ("NN", "PL", "Monday", "14:00", "17:00", "I10", "30", "Thursday"),
            ("AH", "DB", "Monday", "09:00", "14:00", "I11", "30", "Wednesday"),
            ("RC", "SI", "Tuesday", "09:00", "14:00", "I10", "30", "Friday"),
            ("KL", "OR", "Tuesday", "09:00", "14:00", "I12", "30", "Friday"),
        ],
        [
            (["CSE"], "PROF"),
            (["ROOM", "ID"], "PROF"),
            (["DAY", "BEGIN", "ROOM"], "PROF"),
            (["DAY", "END", "ROOM"], "PROF"),
            (["PROF"], "CSE"),
            (["ROOM", "ID"], "CSE"),
            (["DAY", "BEGIN", "ROOM"], "CSE"),
            (["DAY", "END", "ROOM"], "CSE"),
            (["PROF"], "DAY"),
            (["CSE"], "DAY"),
            (["ID"], "DAY"),
            (["PROF"], "BEGIN"),
            (["CSE"], "BEGIN"),
            (["END"], "BEGIN"),
            (["ID"], "BEGIN"),
            (["PROF"], "END"),
            (["CSE"], "END"),
            (["ID"], "END"),
            (["BEGIN", "ROOM"], "END"),
            (["BEGIN", "CAP"], "END"),
            (["PROF"], "ROOM"),
            (["CSE"], "ROOM"),
            (["PROF"], "CAP"),
            (["CSE"], "CAP"),
            (["END"], "CAP"),
            (["ROOM"], "CAP"),
            (["ID"], "CAP"),
            (["PROF"], "ID"),
            (["CSE"], "ID"),
            (["DAY", "END"], "ID"),
            (["DAY", "BEGIN", "ROOM"], "ID"),
            (["DAY", "BEGIN", "CAP"], "ID"),
        ],
    ),
    "1": (
        ["A", "B", "C", "D"],
        [
            ("1", "1", "0", "0"),
            ("1", "2", "1", "4"),
            ("3", "1", "3", "0"),
            ("2", "2", "5", "4"),
            ("1", "1", "0", "0"),
        ],
        [
            (["C"], "A"),
            (["C"], "B"),
            (["D"], "B"),
            (["A", "B"], "C"),
            (["A", "D"], "C"),
            (["B"], "D"),
            (["C"], "D"),
        ],
    ),
    "2": (
        ["A", "B", "C"],
        [
            ("1", "2", "4"),
            ("1", "3", "5"),
            ("2", "2", "5"),
            ("3", "1", "6"),
            ("3", "2", "6"),
        ],
        [
            (["B", "C"], "A"),
            (["A", "B"], "C"),
        ],
    ),
    "3": (
        ["A", "B", "C", "D"],
        [
            ("1", "1", "0", "0"),
            ("1", "2", "1", "4"),
            ("3", "1", "3", "0"),
            ("2", "2", "5", "4"),
            ("1", "1", "0", "1"),
        ],
        [
            (["C"], "A"),
            (["C"], "B"),
            (["D"], "B"),
            (["A", "B"], "C"),
            (["A", "D"], "C"),
        ],
    ),
    "4": (
        ["A", "B", "C"],
        [
            ("1", "2", "4"),
            ("1", "3", "5"),
            ("2", "3", "6"),
            ("3", "2", "6"),
        ],
        [
            (["B", "C"], "A"),
            (["A", "C"], "B"),
            (["A", "B"], "C"),
        ],
    ),
    "5": (
        ["A", "B", "C"],
        [
            ("1", "3", "4"),
            ("1", "3", "5"),
            ("2", "3", "6"),
            ("3", "2", "6"),
        ],
        [
            (["B", "C"], "A"),
            (["A"], "B"),
        ],
    ),
    "6": (
        ["A", "B", "C"],
        [
            ("1", "2", "5"),
            ("2", "3", "4"),
            ("2", "3", "4"),
            ("3", "5", "5"),
            ("4", "3", "5"),
        ],
        [
            (["B", "C"], "A"),
            (["A"], "B"),
            (["A"], "C"),
        ],
    ),
    "7": (
        ["A", "B", "C"],
        [
            ("1", "2", "5"),
            ("2", "2", "4"),
            ("3", "3", "4"),
            ("4", "3", "4"),
        ],
        [
            (["A"], "B"),
            (["A"], "C"),
        ],
    ),
    "8": (
        ["A", "B", "C", "D"],
        [
            ("197", "145", "101", "171"),
            ("57", "70", "145", "112"),
            ("197", "70", "130", "39"),
            ("122", "10", "137", "15"),
            ("113", "72", "18", "124"),
        ],
        [
            (["C"], "A"),
            (["D"], "A"),
            (["C"], "B"),
            (["D"], "B"),
            (["D"], "C"),
            (["A", "B"], "C"),
            (["C"], "D"),
            (["A", "B"], "D"),
        ],
    ),
    "9": (
        ["A", "B", "C"],
        [
            ("2", "1", "1"),
            ("1", "2", "2"),
            ("2", "2", "3"),
        ],
        [
            (["C"], "A"),
            (["C"], "B"),
            (["A", "B"], "C"),
        ],
    ),
    "10": (
        ["PROF", "CSE", "DAY", "BEGIN", "END", "ROOM", "CAP", "ID"],
        [
            ("NF", "AL", "Tuesday", "09:00", "11:00", "A2", "150", "1"),
            ("DM", "NW", "Friday", "09:00", "11:00", "A2", "150", "2"),
            ("ML", "OS", "Monday", "09:00", "12:00", "I10", "30", "3"),
            ("NN", "PL", "Monday", "14:00", "17:00", "I10", "30", "4"),
            ("AH", "DB", "Monday", "09:00", "12:00", "I11", "30", "3"),
            ("RC", "SI", "Tuesday", "09:00", "12:00", "I10", "30", "5"),
            ("KL", "OR", "Tuesday", "09:00", "12:00", "I12", "30", "5"),
        ],
        [
            (["CSE"], "PROF"),
            (["ROOM", "ID"], "PROF"),
            (["DAY", "BEGIN", "ROOM"], "PROF"),
            (["DAY", "END", "ROOM"], "PROF"),
            (["PROF"], "CSE"),
            (["ROOM", "ID"], "CSE"),
            (["DAY", "BEGIN", "ROOM"], "CSE"),
            (["DAY", "END", "ROOM"], "CSE"),
            (["PROF"], "DAY"),
            (["CSE"], "DAY"),
            (["ID"], "DAY"),
            (["PROF"], "BEGIN"),
            (["CSE"], "BEGIN"),
            (["END"], "BEGIN"),
            (["ID"], "BEGIN"),
            (["PROF"], "END"),
            (["CSE"], "END"),
            (["ID"], "END"),
            (["BEGIN", "ROOM"], "END"),
            (["BEGIN", "CAP"], "END"),
            (["PROF"], "ROOM"),
            (["CSE"], "ROOM"),
            (["PROF"], "CAP"),
            (["CSE"], "CAP"),
            (["END"], "CAP"),
            (["ROOM"], "CAP"),
            (["ID"], "CAP"),
            (["PROF"], "ID"),
            (["CSE"], "ID"),
            (["DAY", "END"], "ID"),
            (["DAY", "BEGIN", "ROOM"], "ID"),
            (["DAY", "BEGIN", "CAP"], "ID"),
        ],
    ),
    "11": (
        ["A", "B", "C", "D"],
        [
            ("1", "2", "1", "2"),
            ("1", "2", "2", "2"),
            ("1", "2", "3", "3"),
        ],
        [
            ([], "A"),
            ([], "B"),
            (["C"], "D"),
        ],
    ),
    "12": (
        ["A", "B", "C"],
        [
            ("1", "2", "2"),
            ("1", "3", "3"),
            ("1", "2", "2"),
        ],
        [
            ([], "A"),
            (["C"], "B"),
            (["B"], "C"),
        ],
    ),
    "13": (
        ["A", "B", "C"],
        [
            ("1", "2", "1"),
            ("1", "2", "2"),
            ("1", "2", "3"),
        ],
        [
            ([], "A"),
            ([], "B"),
        ],
    ),
    "14": (
        ["A", "B", "C"],
        [
            ("2012", "4", "N324AA"),
            ("2012", "5", "N338AA"),
            ("2012", "6", "N323AA"),
            ("2012", "7", "N335AA"),
            ("2012", "1", "N335AA"),
            ("2012", "4", ""),
        ],
        [
            ([], "A"),
        ],
    ),
    "15": (
        ["A", "B", "C"],
        [
            ("2012", "1", "1"),
            ("2012", "1", "2"),
            ("2012", "2", "2"),
        ],
        [
            ([], "A"),
        ],
    ),
    "16": (
        ["A", "B", "C"],
        [
            ("1", "6", "11"),
            ("2", "7", "12"),
            ("3", "8", "13"),
            ("4", "9", "14"),
            ("5", "10", "15"),
        ],
        [
            (["B"], "A"),
            (["C"], "A"),
            (["A"], "B"),
            (["C"], "B"),
            (["A"], "C"),
            (["B"], "C"),
        ],
    ),
    "17": (
        ["A", "B", "C"],
        [],
        [
            ([], "A"),
            ([], "B"),
            ([], "C"),
        ],
    ),
    "20": (
        ["A", "B", "C", "D", "E", "F"],
        [
            ("a", "a", "b", "c", "a", "c"),
            ("b", "c", "a", "d", "a", "c"),
            ("c", "a", "c", "b", "c", "d"),
            ("d", "d", "c", "d", "b", "d"),
            ("e", "d", "c", "d", "e", "d"),
            ("f", "d", "c", "d", "b", "f"),
        ],
        [
            (["B", "E", "F"], "A"),
            (["C", "E", "F"], "A"),
            (["D", "E", "F"], "A"),
            (["A"], "B"),
            (["C", "D"], "B"),
            (["C", "E"], "B"),
            (["D", "E"], "B"),
            (["D", "F"], "B"),
            (["A"], "C"),
            (["B", "D"], "C"),
            (["B", "E"], "C"),
            (["B", "F"], "C"),
            (["D", "E"], "C"),
            (["D", "F"], "C"),
            (["A"], "D"),
            (["B", "C"], "D"),
            (["B", "E"], "D"),
            (["B", "F"], "D"),
            (["C", "E"], "D"),
            (["A"], "E"),
            (["A"], "F"),
        ],
    ),
}
# The dependencies of data/bridges.csv, the Pittsburgh bridges of the UCI Machine Learning Repository, by column number.
BRIDGES = [
    ([3, 4], 1),
    ([4, 5, 6], 1),
    ([4, 6, 12], 1),
    ([4, 6, 13], 1),
    ([1], 2),
    ([3], 2),
    ([4, 6], 2),
    ([1], 3),
    ([4, 5, 6], 3),
    ([4, 6, 12], 3),
    ([4, 6, 13], 3),
    ([1], 4),
    ([1], 5),
    ([3, 4], 5),
    ([3, 7, 10], 5),
    ([3, 7, 12], 5),
    ([4, 6, 12], 5),
    ([4, 6, 13], 5),
    ([2, 4, 9, 12], 5),
    ([2, 4, 10, 13], 5),
    ([2, 4, 12, 13], 5),
    ([3, 6, 7, 9], 5),
    ([3, 6, 7, 11], 5),
    ([3, 7, 8, 9], 5),
    ([3, 7, 8, 11], 5),
    ([3, 7, 9, 13], 5),
    ([3, 7, 11, 13], 5),
    ([4, 7, 8, 12], 5),
    ([4, 7, 9, 12], 5),
    ([4, 7, 10, 13], 5),
    ([4, 7, 12, 13], 5),
    ([1], 6),
    ([3, 4], 6),
    ([1], 7),
    ([3, 4], 7),
    ([4, 6], 7),
    ([3, 5, 6, 13], 7),
    ([2, 4, 5, 8, 11], 7),
    ([2, 4, 8, 9, 11], 7),
    ([2, 4, 8, 11, 13], 7),
    ([3, 5, 6, 8, 9], 7),
    ([3, 5, 6, 9, 10], 7),
    ([3, 5, 6, 9, 11], 7),
    ([3, 5, 6, 9, 12], 7),
    ([1], 8),
    ([3, 4], 8),
    ([4, 6], 8),
    ([3, 6, 10], 8),
    ([3, 6, 12], 8),
    ([3, 6, 13], 8),
    ([3, 10, 13], 8),
    ([6, 10, 11], 8),
    ([2, 5, 6, 10], 8),
    ([2, 6, 10, 12], 8),
    ([3, 6, 7, 9], 8),
    ([3, 7, 12, 13], 8),
    ([5, 6, 7, 10], 8),
    ([6, 7, 10, 12], 8),
    ([2, 5, 6, 9, 12], 8),
    ([2, 6, 7, 9, 12], 8),
    ([2, 6, 9, 11, 13], 8),
    ([2, 6, 9, 12, 13], 8),
    ([3, 5, 6, 9, 11], 8),
    ([6, 7, 9, 12, 13], 8),
    ([6, 9, 11, 12, 13], 8),
    ([1], 9),
    ([3, 4], 9),
    ([4, 6], 9),
    ([4, 11, 13], 9),
    ([1], 10),
    ([3, 4], 10),
    ([4, 6], 10),
    ([2, 4, 5], 10),
    ([2, 4, 12], 10),
    ([4, 5, 11], 10),
    ([4, 11, 12], 10),
    ([3, 5, 6, 8], 10),
    ([3, 5, 6, 12], 10),
    ([3, 5, 6, 13], 10),
    ([3, 6, 7, 9], 10),
    ([3, 6, 7, 12], 10),
    ([3, 6, 8, 11], 10),
    ([3, 6, 9, 13], 10),
    ([3, 6, 11, 12], 10),
    ([3, 6, 11, 13], 10),
    ([3, 6, 12, 13], 10),
    ([3, 7, 12, 13], 10),
    ([3, 8, 12, 13], 10),
    ([3, 5, 6, 9, 11], 10),
    ([1], 11),
    ([3, 4], 11),
    ([4, 6], 11),
    ([2, 4, 7, 9, 13], 11),
    ([1], 12),
    ([3, 4], 12),
    ([3, 6, 10], 12),
    ([3, 7, 10], 12),
    ([4, 5, 6], 12),
    ([4, 6, 13], 12),
    ([2, 6, 11, 13], 12),
    ([3, 5, 6, 8], 12),
    ([3, 5, 6, 13], 12),
    ([3, 6, 7, 9], 12),
    ([3, 6, 8, 9], 12),
    ([3, 6, 8, 11], 12),
    ([3, 6, 9, 13], 12),
    ([3, 6, 11, 13], 12),
    ([2, 5, 6, 8, 11], 12),
    ([2, 5, 6, 10, 11], 12),
    ([3, 5, 6, 9, 11], 12),
    ([2, 5, 6, 7, 8, 9], 12),
    ([2, 5, 6, 7, 9, 10], 12),
    ([2, 6, 7, 8, 9, 13], 12),
    ([5, 6, 7, 8, 9, 13], 12),
    ([5, 6, 7, 9, 10, 13], 12),
    ([5, 6, 8, 9, 11, 13], 12),
    ([5, 6, 9, 10, 11, 13], 12),
    ([1], 13),
    ([3, 4], 13),
    ([4, 5, 6], 13),
    ([4, 6, 12], 13),
    ([3, 6, 7, 8], 13),
    ([3, 6, 7, 9], 13),
    ([3, 6, 7, 10], 13),
    ([3, 6, 7, 12], 13),
    ([3, 6, 9, 10], 13),
    ([2, 4, 5, 9, 11], 13),
    ([2, 4, 9, 11, 12], 13),
    ([2, 5, 6, 7, 10], 13),
    ([2, 5, 6, 9, 10], 13),
    ([3, 5, 6, 8, 9], 13),
    ([3, 5, 6, 9, 11], 13),
    ([3, 5, 6, 9, 12], 13),
    ([3, 6, 8, 9, 11], 13),
    ([3, 6, 9, 11, 12], 13),
    ([2, 5, 6, 7, 8, 11], 13),
    ([2, 5, 6, 7, 11, 12], 13),
    ([2, 5, 6, 8, 9, 11], 13),
    ([2, 5, 6, 9, 11, 12], 13),
    ([2, 6, 7, 9, 10, 12], 13),
    ([5, 6, 7, 8, 11, 12], 13),
    ([5, 6, 7, 10, 11, 12], 13),
]
# End of fixed values.


def relation(key):
    columns, rows, fds = FIXTURES[key]
    return columns, rows, {(frozenset(lhs), rhs) for lhs, rhs in fds}


def bridges():
    return {(frozenset(f"column{i}" for i in lhs), f"column{rhs}") for lhs, rhs in BRIDGES}
