"""Training-data operators: quality, near copies, mixing, search, lines, toxicity, private data, benchmark leaks, chats, long repeats."""
