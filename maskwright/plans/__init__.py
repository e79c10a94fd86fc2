"""Plans: sanitise, scan and restore, from source to result."""
