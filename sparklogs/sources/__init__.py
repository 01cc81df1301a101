"""Where logs come from and go to: request bodies, the partitioned table, COPY text, generated rows."""
