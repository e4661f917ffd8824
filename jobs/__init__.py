"""Jobs that are run from the command line on tables of files; each has a function that takes a session and a configuration."""
