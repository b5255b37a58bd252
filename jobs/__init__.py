"""Jobs to be submitted: each has a command line, a config file beside it, and a function that takes a session."""
