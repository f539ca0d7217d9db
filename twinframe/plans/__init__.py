"""Plans: tables of file operations. No file is touched."""
