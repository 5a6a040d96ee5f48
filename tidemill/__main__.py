from tidemill.cli import main

raise SystemExit(main())
