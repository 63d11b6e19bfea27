"""Named queries over the library's operators, and SQL that they are held against."""
